"""Byte-pair encoding by forced-boundary splitting, and decoding.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never be merged, so a word may be cut
between them before any merge is tried. The fragments are encoded on their own, which makes them short and often seen
before, and their ids are joined. Results equal those of the tokenizers library with the same vocabulary file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm._tables import free, table
from terralens.llm._text import pieces, tidied
from terralens.llm.sst import WordMemory, packed_ids, plain_merges, spelled, word_finder


def word_pattern(spec: dict) -> str:
    """The pattern by which a vocabulary file cuts words; raises ValueError for files of another make than is done here."""
    normal = (spec.get("normalizer") or {}).get("normalizers") or []
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec["model"]
    ours = (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cutters] == ["Split", "ByteLevel"]
        and (cutters[0]["behavior"], cutters[0]["invert"], "Regex" in cutters[0]["pattern"]) == ("Removed", True, True)
        and not cutters[1]["add_prefix_space"] and not cutters[1]["use_regex"]
        and plain_merges(model)
    )
    if not ours:
        raise ValueError("not a vocabulary that lower-cases, cuts by a pattern and merges bytes of words")
    return cutters[0]["pattern"]["Regex"]


class ForcedBoundaryBpe:
    """Encoder and decoder of a word vocabulary with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, models

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        bare = [t.removesuffix(self.suffix) if self.suffix else t for t in vocab]
        #: pairs of neighbours inside some token; between all others a word is cut
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        self.last = models.BPE(vocab, merges, end_of_word_suffix=self.suffix)  # for a word's last fragment
        self.inner = models.BPE(vocab, merges)  # for the others
        self.library = Tokenizer.from_file(path)  # texts with a special token's string only
        self.library.no_truncation()
        self.library.no_padding()
        special = self.library.get_added_tokens_decoder()
        self.special = regex.compile("|".join(regex.escape(t.content) for t in special.values()))
        self.words = word_finder(word_pattern(spec))
        names = {i: t for t, i in vocab.items()} | {i: t.content for i, t in special.items()}
        self.names = [names[i].encode() for i in range(max(names) + 1)]
        self.fragments, self.known = WordMemory(self._fragment, 60_000), WordMemory(self._word, 120_000)

    def forget(self) -> None:
        for memory in (self.fragments, self.known):
            memory.clear()
            memory.old = {}

    def cuts(self, word: str) -> list[str]:
        """The fragments of a word of byte letters."""
        out, begin = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.inside:
                out.append(word[begin:i])
                begin = i
        return [*out, word[begin:]]

    def _fragment(self, key: tuple[str, bool]) -> bytes:
        return packed_ids(self.last if key[1] else self.inner, key[0])

    def _word(self, word: str) -> bytes:
        *inner, last = self.cuts(spelled(word))
        return b"".join([*(self.fragments[x, False] for x in inner), self.fragments[last, True]])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            # the library lower-cases letter by letter, without the rule for a sigma at a word's end
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.known.__getitem__, self.words(text.lower())))

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8: the vocabulary names no decoder, so its tokens stand side by side, a space between."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def coder(path: str) -> ForcedBoundaryBpe:
    """One for each worker process."""
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, vocabulary: str, *keep: str) -> DataFrame:
    """The named columns and `ids` (little-endian unsigned 32-bit integers) of every whole text.

    Null texts are empty and have no ids; one row out for each row in, repeated or not; an empty table gives none.
    Texts are read in pieces of about 1 MB. `vocabulary` must be a path that every executor has.
    """
    (whole,) = free([*keep, "ids"], "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch, whole)):
            ids = [coder(vocabulary).encode(t.as_py()) for t in b.column(whole)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.binary())], [*keep, "ids"])
        coder(vocabulary).forget()  # the worker lives on beside others

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    filled = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(whole))
    return filled.mapInArrow(tidied(run, 30), f"{kinds}ids binary")


def decode(encoded: DataFrame, vocabulary: str, *keep: str) -> DataFrame:
    """The named columns and `decoded`, the text of `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [coder(vocabulary).decode(x.as_py()).decode("utf-8", "replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "decoded"])

    kinds = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in keep)
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, f"{kinds}decoded string")


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_forced_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of each row of `documents`.

    Null texts count as empty and have no ids, repeated rows are encoded alike, an empty table gives none, other columns
    are ignored; see encode and decode.
    """
    path = vocabulary_path()
    docs = table(spark, sf_dir, "documents")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(coder(path).decode(x)).hexdigest()) for x in (y.as_py() for y in b.column("ids"))]
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    encoded = encode(docs, path, "doc_id")
    return encoded.mapInArrow(digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
