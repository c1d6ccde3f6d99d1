"""Token ids in sorted-string-table shards.

A shard holds documents by ascending key: blocks of about 64 KB in which keys are prefix-compressed, a sparse index
(each block's first key, place and size), a Bloom filter of all keys, and a footer that says where these are. A shard is
one value of a binary column, so tables of shards are written and read by Spark on any store that it reaches; its index,
filter and footer stand in a column of their own too. A lookup asks key ranges and filters by that column alone, then
reads the shards that may hold a key, searches their index by bisection, reads one block and scans it.

Keys are 9 bytes: 0 for a null identifier, or 1 and the identifier as a big-endian 64-bit integer with its sign bit
turned, so that byte order is numeric order. Ids take two bytes each while all fit, else four.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm._tables import input_mb, table, texts, written

MAGIC = b"TLSST\x00\x01\n"
#: index place and size, filter place and size, documents, ids, hash functions of the filter
_FOOTER = struct.Struct("<QQQQQQI8s")
_INDEX = struct.Struct("<9sQI")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 4 << 20
BITS_PER_KEY = 10


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, count: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return ((a + i * b) % bits for i in range(count))


class ShardWriter:
    """Takes documents in ascending order of key and gives a shard's bytes."""

    def __init__(self) -> None:
        self.body, self.index, self.keys = bytearray(MAGIC), [], []
        self.block, self.first, self.last = bytearray(), b"", b""
        self.raw = self.ids = 0
        self._pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if key < self.last:
            raise ValueError("documents must come in ascending order")
        shared = 0
        if not self.block:
            self.first = key
        else:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        self.block += bytes((shared, width)) + key[shared:] + _varint(len(ids)) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
        self.keys.append(key)
        self.last, self.ids = key, self.ids + len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            packed = self._pack.compress(bytes(self.block))
            self.index.append(_INDEX.pack(self.first, len(self.body), len(packed)))
            self.body += packed
            self.raw += len(self.block)
            self.block = bytearray()

    @property
    def size(self) -> int:
        return len(self.body) + len(self.block)

    def finish(self) -> bytes:
        self._close_block()
        bits, count = max(64, len(self.keys) * BITS_PER_KEY), 7
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[list(_probes(key, bits, count))] = True
        index, packed = b"".join(self.index), struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        at = len(self.body)
        footer = _FOOTER.pack(at, len(index), at + len(index), len(packed), len(self.keys), self.ids, count, MAGIC)
        self.tail = index + packed + footer
        return bytes(self.body) + self.tail


def tail_may_hold(tail: bytes, doc_ids: list) -> bool:
    """Whether the filter in a shard's tail (index, filter and footer) admits any of the identifiers."""
    at, _, bloom_at, _, _, _, count, magic = _FOOTER.unpack_from(tail, len(tail) - _FOOTER.size)
    if magic != MAGIC:
        raise ValueError("not the tail of a shard")
    at = bloom_at - at
    bits = struct.unpack_from("<Q", tail, at)[0]
    return any(all(tail[at + 8 + (p >> 3)] >> (7 - (p & 7)) & 1 for p in _probes(key_of(x), bits, count)) for x in doc_ids)


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes) -> None:
        *places, magic = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.data = data
        at, size, self._bloom_at, self._bloom_size, self.n_docs, self.n_ids, self._count = places
        self.index = [_INDEX.unpack_from(data, at + k) for k in range(0, size, _INDEX.size)]
        self._firsts = [k for k, _, _ in self.index]
        self._unpack = zstandard.ZstdDecompressor()

    def may_hold(self, doc_id: int | None) -> bool:
        bits = struct.unpack_from("<Q", self.data, self._bloom_at)[0]
        return all(self.data[self._bloom_at + 8 + (p >> 3)] >> (7 - (p & 7)) & 1 for p in _probes(key_of(doc_id), bits, self._count))

    def _documents(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size = self.index[block]
        data, key, at = self._unpack.decompress(self.data[at : at + size]), b"", 0
        while at < len(data):
            shared, width = data[at], data[at + 1]
            key = key[:shared] + data[at + 2 : at + 11 - shared]
            n, at = _read_varint(data, at + 11 - shared)
            yield key, np.frombuffer(data, "<u2" if width == 2 else "<u4", n, at)
            at += n * width

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.index)):
            for key, ids in self._documents(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this identifier, mostly one."""
        if not self.index or not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        for block in range(max(0, bisect.bisect_left(self._firsts, key) - 1), len(self.index)):
            if self._firsts[block] > key:
                break
            out += [ids for k, ids in self._documents(block) if k == key]
        return out


# --- encoding ---------------------------------------------------------------------------------------------------

#: The pre-tokenizer of the byte-level vocabulary (a fixed pattern of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Letters, numbers and white space among the first 256 code points, for texts that hold no others.
LATIN = {"L": "A-Za-zªµºÀ-ÖØ-öø-ÿ", "N": "0-9²³¹¼-¾", "S": "\t-\r \u0085\u00a0"}


def word_finder(pattern: str):
    """A function that cuts a text into the pattern's words; texts of Latin-1 take the faster standard library."""
    import regex

    classes = {r"\p{L}": LATIN["L"], r"\p{N}": LATIN["N"], r"\s": LATIN["S"]}
    # inside brackets a class's members are put in; outside them a class gets brackets of its own
    narrow = re.sub(r"\[\^?[^\]]*\]|\\p\{.\}|\\[sS]", lambda m: _narrowed(m[0], classes), pattern)
    wide, latin = regex.compile(pattern).findall, re.compile(narrow).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return latin(text)

    return find


def _narrowed(part: str, classes: dict[str, str]) -> str:
    if part == r"\S":
        return f"[^{classes[chr(92) + 's']}]"
    inner = part[1:-1] if part[0] == "[" else part
    for name, members in classes.items():
        inner = inner.replace(name, members)
    return f"[{inner}]"


class WordMemory(dict):
    """word -> value, computed on demand by `make` and kept for a while.

    Words live in two generations of at most `most` each; when the young one is full, the old one goes and words seen
    again move on. The memory only saves time.
    """

    def __init__(self, make, most: int = 200_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


def plain_merges(model: dict) -> bool:
    """Whether a vocabulary file's model is byte-pair merges without chance, fallbacks or prefixes."""
    return model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))


class CachedEncoder:
    """Encodes texts as the tokenizers library does, word by word with a bounded memory of words seen before.

    The vocabulary's pre-tokenizer cuts every text into words that are merged on their own, so a text's ids are those of
    its words; words not in memory go to the library's merge model.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex") or not plain_merges(spec["model"]) or spec["model"].get("end_of_word_suffix"):
            raise ValueError("not a vocabulary that cuts by the byte-level pattern and merges bytes")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.words = word_finder(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values()))
        self.known = WordMemory(self._one)

    def _one(self, word: str) -> bytes:
        return packed_ids(self.model, spelled(word))

    def encode(self, text: str) -> np.ndarray:
        """The text's ids as 32-bit integers."""
        if self.special.search(text):  # the string of a special token, which the library treats on its own
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words(text))), "<u4")


def spelled(word: str) -> str:
    """The word's UTF-8 bytes as the letters that stand for them."""
    if word.isascii() and word[1:].isalnum():
        return "Ġ" + word[1:] if word[0] == " " else word if word.isalnum() else word.translate(_LETTERS)
    return word.encode().decode("latin-1").translate(_LETTERS)


def packed_ids(model, spelling: str) -> bytes:
    out = array("I", [t.id for t in model.tokenize(spelling)])
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printed)
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = byte_letters()


@functools.cache
def encoder(path: str) -> CachedEncoder:
    """One for each worker process."""
    return CachedEncoder(path)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Encodes all documents and writes them as shards in ascending order of doc_id; gives the table of shards.

    Columns: shard (its place in key order), first_id, last_id, n_docs, n_ids, tail, data. Documents are dealt by ranges of
    doc_id and sorted on disk within each, then encoded and packed one after the other, so that memory holds one shard
    of about 4 MB. `end_id` follows each document. Null doc_ids come first, null texts are empty, equal doc_ids go by
    text and all stay, an empty table gives no shards; other columns are ignored. `vocabulary` must be a path that
    every executor has.
    """
    base = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    spark = docs.sparkSession
    mb = input_mb(docs)  # as a petabyte where the optimizer has no idea
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(mb / 64) + 1 if mb < 1e9 else 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from terralens.llm._text import pieces

        place, n = TaskContext.get().partitionId() << 32, 0
        writer, first, last = ShardWriter(), None, None

        def finished() -> pa.RecordBatch:
            data = writer.finish()
            row = [place + n, first, last, len(writer.keys), writer.ids, writer.tail, data]
            kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["shard", "first_id", "last_id", "n_docs", "n_ids", "tail", "data"])

        for b in batches:
            for piece in pieces(b):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids = encoder(vocabulary).encode(text)
                    first = doc_id if not writer.keys else first
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                    last = doc_id
                    if writer.size >= SHARD_BYTES:
                        yield finished()
                        writer, n = ShardWriter(), n + 1
        if writer.keys:
            yield finished()

    dealt = base.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    packed = dealt.mapInArrow(pack, "shard long, first_id long, last_id long, n_docs long, n_ids long, tail binary, data binary")
    # small row groups, so that a look-up passes over shards that it doesn't need
    return written(packed, "shards", **{"parquet.block.size": str(2 * SHARD_BYTES)})


def read_shards(shards: DataFrame) -> DataFrame:
    """(shard, place, doc_id, start, n_tokens, ids): every document of the shards in key order.

    start counts the ids before the document in its shard; ids are little-endian unsigned 32-bit integers.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
                rows, start = [], 0
                for place, (doc_id, ids) in enumerate(Shard(data.as_py())):
                    rows.append((at, place, doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "place", "doc_id", "start", "n_tokens", "ids"])

    return shards.select("shard", "data").mapInArrow(unpack, "shard long, place long, doc_id long, start long, n_tokens long, ids binary")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, before): the ids in all shards before each; one row a shard, so a running sum over sums by partition."""
    from pyspark.sql import Window

    part = F.shiftright("shard", 32)
    sizes = shards.select("shard", part.alias("part"), "n_ids")
    inside = sizes.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each partition of the writer
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return inside.join(ahead, "part").select("shard", (F.col("inside") + F.col("ahead")).alias("before"))


def lookup(shards: DataFrame, ids: list[int | None], most_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, ids) of the documents with the named identifiers, null among them; unknown ones give no row.

    Key ranges and filters, read without the data, tell which shards may hold one; only those are read and searched. At
    most `most_ids` identifiers, for all tasks get them.
    """
    wanted = sorted({x for x in ids if x is not None})
    null = any(x is None for x in ids)
    if len(wanted) > most_ids:
        raise ValueError(f"at most {most_ids} identifiers at once")

    def inside(first: int | None, last: int | None) -> list[int | None]:
        """Those between a shard's first and last, which are null for null ones; these come first."""
        begin = 0 if first is None else bisect.bisect_left(wanted, first)
        end = 0 if last is None else bisect.bisect_right(wanted, last)
        return [*([None] if null and first is None else []), *wanted[begin:end]]

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("first_id", "last_id")), b.column("tail"), strict=True)
            yield b.select(["shard"]).filter(pa.array([bool(of := inside(first, last)) and tail_may_hold(tail.as_py(), of) for first, last, tail in rows], pa.bool_()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("first_id", "last_id")), b.column("data"), strict=True)
            found = [(x, got.astype("<u4").tobytes()) for first, last, data in rows for s in [Shard(data.as_py())] for x in inside(first, last) for got in s.get(x)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["doc_id", "ids"])

    hits = written(shards.select("shard", "first_id", "last_id", "tail").mapInArrow(holding, "shard long"), "hits")
    n = hits.count()
    if n <= 1000:  # their numbers reach the scan
        shards = shards.filter(F.col("shard").isin([r[0] for r in hits.collect()]))
    else:
        shards = shards.join(F.broadcast(hits) if n <= most_ids else hits, "shard", "left_semi")
    return shards.select("first_id", "last_id", "data").mapInArrow(search, "doc_id long, ids binary")


def op4_token_shards(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of `documents`, read back from its shards."""
    import public_tokenizers

    shards = write_shards(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    # crc32 of the ids read back, JVM-side
    rows = read_shards(shards).select("shard", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(F.broadcast(shard_starts(shards)) if shards.count() <= 100_000 else shard_starts(shards), "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
