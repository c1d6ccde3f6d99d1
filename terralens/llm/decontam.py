"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Items fall into length classes, each at most a quarter shorter than its items. An item has the SimHash of its first and of
its last class-length words; a document has that of every window of as many words, from running sums of the words'
weighted signs. A 64-bit fingerprint is four blocks of 16 bits: two fingerprints that differ in at most 11 bits differ in
at most two bits of some block, so tables of all block values within two bits of an item's find every such pair.

Changed runs of neighbouring words move fingerprints of long items further than that. A pair that reaches 0.75 still has
unchanged words in a row: of n words, e changes keep a plain similarity of 0.75 only for n - 4 >= 35 e, so that one of the
gaps between them has 15 words at least (9 below 22 words). So items are cut into blocks of 8 (5) words, one of which lies
in such a gap, and every window of as many words of a document is looked up among them. A candidate is verified by the
weighted Jaccard similarity of a window's 5-word shingles with the item's, a shingle weighing log(1 + items / items with
it): of the item-sized window, or where that falls short of the best one around. A window reaches the threshold t if
shared weight - t * other weight of the window >= t * the item's, each shingle counted once, so the window with the
largest left side is it: a running sum finds it, or where shingles repeat one sum for each place to begin.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terralens.llm import _text
from terralens.llm._tables import free, table

U = np.uint64
RADIUS = 11
#: Bytes of text handled at once: their running sums fit a core's cache.
PIECE = 1 << 15
_STEP = 1.35
_BLOCKS = 4
#: (fewest, most) words of an item, and the words of its anchors; shorter items are classes of their own length.
_ANCHORS = ((5, 21, 5), (22, 1 << 60, 8))
_LOW = U((1 << 18) - 1)
#: All 16-bit values of at most RADIUS // _BLOCKS bits.
_NEAR = np.array([sum(1 << b for b in bits) for k in range(RADIUS // _BLOCKS + 1) for bits in itertools.combinations(range(16), k)], np.int64)


def class_lengths(longest: int) -> list[int]:
    """1, 2, 3, ... and from 5 on steps of a third, up to the longest item."""
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, int(out[-1] * _STEP)))
    return out


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U), np.zeros(0, np.int64))


class Statistics:
    """Of how many items, and in how many of them words and shingles occur; those of one item may be left out."""

    def __init__(self, n: int, words: np.ndarray, words_df: np.ndarray, shingles: np.ndarray, shingles_df: np.ndarray) -> None:
        self.n, self.words, self.words_df, self.shingles, self.shingles_df = max(1, n), words, words_df, shingles, shingles_df

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        often = self.words_df >= max(2, 0.02 * self.n)
        return self.words[often], np.where(self.words_df[often] >= max(3, 0.1 * self.n), 1, 2).astype(np.int16)

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        shared = self.shingles_df > 1
        return self.shingles[shared], np.log1p(self.n / self.shingles_df[shared]), float(np.log1p(self.n))


class Items:
    """The benchmark's items, made ready for search; it is as large as the benchmark and goes to every task."""

    def __init__(self, ids: list, texts: list[str], k: int = 5, whole: "Statistics | None" = None) -> None:
        """`whole`: the whole benchmark's statistics where these items are a group of it."""
        self.k = k
        filled = [(i, t) for i, t in zip(ids, texts, strict=True) if t and t.strip()]
        column = pa.array([t for _, t in filled], pa.string())
        hashes, first = _text.word_hashes(*_text.buffers(column))
        keep = np.flatnonzero(np.diff(first) > 0)
        self.ids = [filled[i][0] for i in keep]
        self.words = [hashes[first[i] : first[i + 1]] for i in keep]
        sets = [np.unique(_text.shingles(w, np.array([0, len(w)]), k)[0]) for w in self.words]
        if whole is None:
            words, df = _counted([np.unique(w) for w in self.words])
            whole = Statistics(len(self.words), words, df, *_counted(sets))
        self.common, self.common_weight = whole.common()
        # a shingle of one item weighs as much as one of none, so only shared ones are kept
        self.shingles, self.weights, self.unknown = whole.weights()
        self.sets, self.totals = sets, [float(self.weight(s).sum()) for s in sets]
        lengths = class_lengths(max((len(w) for w in self.words), default=1))
        self.classes: dict[int, dict] = {}
        for item, w in enumerate(self.words):
            c = max(x for x in lengths if x <= len(w))
            for offset in {0, len(w) - c}:
                of = self.classes.setdefault(c, {"item": [], "offset": [], "words": []})
                of["item"].append(item)
                of["offset"].append(offset)
                of["words"].append(w[offset : offset + c])
        for c, of in self.classes.items():
            prints = np.array([self.fingerprints(w, len(w))[0] for w in of.pop("words")], U)
            of["prints"], of["item"], of["offset"] = prints, np.array(of["item"]), np.array(of["offset"])
            of["tables"] = [self._table(prints, b) for b in range(_BLOCKS)]
            of["many"] = [np.diff(at).astype(np.int32) for at, _ in of["tables"]]
            of["hit"] = [many > 0 for many in of["many"]]

        self.anchors = [a for fewest, most, q in _ANCHORS if (a := self._anchors(fewest, most, q))]

    def _anchors(self, fewest: int, most: int, q: int) -> tuple | None:
        """(q, sorted keys, their items, their offsets, which low bits occur) of the blocks of items of such lengths."""
        rows = [(item, o) for item, w in enumerate(self.words) if fewest <= len(w) <= most for o in {*range(0, len(w) - q + 1, q), len(w) - q}]
        if not rows:
            return None
        item, offset = np.array(rows).T
        keys = np.array([_text.mix(self.words[i][o : o + q]).sum(dtype=U) for i, o in rows], U)
        order = np.argsort(keys, kind="stable")
        occurs = np.zeros(int(_LOW) + 1, bool)
        occurs[(keys & _LOW).astype(np.int64)] = True
        return q, keys[order], item[order], offset[order], occurs

    def anchored(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first word) where a block of the item stands in the text."""
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(_text.mix(words), out=sums[1:])
        for q, keys, items, offsets, occurs in self.anchors:
            if len(words) < q:
                continue
            of = sums[q:] - sums[:-q]
            at = np.flatnonzero(occurs[(of & _LOW).astype(np.int64)])
            lo, hi = np.searchsorted(keys, of[at]), np.searchsorted(keys, of[at], "right")
            n = hi - lo
            at, place = np.repeat(at, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text = np.searchsorted(first, at, "right") - 1
            inside = at + q <= first[text + 1]
            at, place, text = at[inside], place[inside], text[inside]
            begin = np.maximum(first[text], at - offsets[place])
            yield from dict.fromkeys(zip(text.tolist(), items[place].tolist(), begin.tolist(), strict=True))

    @staticmethod
    def _table(prints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """For each value of the block the fingerprints within two bits of it: offsets and their places."""
        value = ((prints >> U(16 * block)) & U(0xFFFF)).astype(np.int64)
        near = (value[:, None] ^ _NEAR).ravel()
        order = np.argsort(near, kind="stable")
        at = np.zeros(65537, np.int32)
        np.cumsum(np.bincount(near, minlength=65536), out=at[1:])
        return at, (order // len(_NEAR)).astype(np.int32)

    def sums(self, words: np.ndarray) -> np.ndarray:
        """Running sums of the words' weighted signs, 64 lanes; differences hold modulo 2**16, which is enough."""
        weight = np.full(len(words), 3, np.int16)
        if len(self.common):
            place = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
            hit = self.common[place] == words
            weight[hit] = self.common_weight[place[hit]]
        bits = np.unpackbits(_text.mix(words ^ U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
        out = np.zeros((len(words) + 1, 64), np.int16)
        np.cumsum((bits.astype(np.int16) * np.int16(2) - np.int16(1)) * weight[:, None], axis=0, dtype=np.int16, out=out[1:])
        return out

    @staticmethod
    def prints_of(sums: np.ndarray, c: int) -> np.ndarray:
        # up to 10,000 words no running sum can pass 16 bits, and comparing them is the same as taking differences
        above = sums[c:] > sums[:-c] if len(sums) <= 10_000 else sums[c:] - sums[:-c] > 0
        return np.packbits(above, axis=1).view(U).ravel()

    def fingerprints(self, words: np.ndarray, c: int) -> np.ndarray:
        return self.prints_of(self.sums(words), c)

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.unknown)
        place = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[place] == shingles, self.weights[place], self.unknown)

    def best_window(self, item: int, words: np.ndarray, least: float) -> tuple[int, int]:
        """(first word, words) of the window that reaches `least` if any does; see the module.

        A shingle counts once in a window, so its second place adds only to windows that begin after its first one.
        """
        of = _text.shingles(words, np.array([0, len(words)]), self.k)[0]
        weight = self.weight(of)
        value = np.where(np.isin(of, self.sets[item]), weight, -least * weight)
        order = np.argsort(of, kind="stable")
        again = np.flatnonzero(of[order][1:] == of[order][:-1])
        if not len(again):
            sums = np.concatenate([[0.0], np.cumsum(value)])
            end = int(np.argmax(sums[1:] - np.minimum.accumulate(sums[:-1])))
            begin = int(np.argmin(sums[: end + 1]))
            return begin, end + 1 - begin + self.k - 1
        before = np.full(len(of), -1)
        before[order[again + 1]] = order[again]
        total, best, begin, end = np.zeros(len(of)), 0.0, 0, 0  # for each first shingle, the window up to the present one
        for j, (v, i) in enumerate(zip(value.tolist(), before.tolist(), strict=True)):
            total[i + 1 : j + 1] += v
            if v > 0 and (top := float(total[: j + 1].max())) > best:
                best, begin, end = top, int(np.argmax(total[: j + 1])), j
        return begin, end + 1 - begin + self.k - 1

    def similarity(self, item: int, words: np.ndarray) -> float:
        """Weighted Jaccard similarity of the item's shingles and the words'."""
        mine, own = np.unique(_text.shingles(words, np.array([0, len(words)]), self.k)[0]), self.sets[item]
        weight = self.weight(mine)
        shared = float(weight[np.isin(mine, own, assume_unique=True)].sum())
        return shared / (self.totals[item] + float(weight.sum()) - shared)

    def candidates(self, c: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, place in the class's fingerprints) of all pairs within RADIUS bits."""
        of, found = self.classes[c], []
        own, blocks = of["prints"], prints.view(np.uint16).reshape(-1, _BLOCKS)  # little-endian: block b is bits 16 b and up
        for b, (at, who) in enumerate(of["tables"]):
            value = np.ascontiguousarray(blocks[:, b])
            where = np.flatnonzero(of["hit"][b][value]).astype(np.int32)
            if not len(where):
                continue
            value = value[where]
            n = of["many"][b][value]
            left = np.repeat(where, n)
            ends = np.cumsum(n, dtype=np.int32)
            right = who[np.arange(len(left), dtype=np.int32) + np.repeat(at[value] - (ends - n), n)]
            close = np.flatnonzero(np.bitwise_count(prints[left] ^ own[right]) <= RADIUS)
            if len(close):
                found.append(left[close].astype(np.int64) * len(own) + right[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.divmod(pairs, max(1, len(own)))

    def leaks(self, words: np.ndarray, first: np.ndarray, least: float) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item) -> (similarity, first word) of the best window, for all pairs that reach `least`."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if not len(words):
            return best
        sums = self.sums(words)
        lengths = np.diff(first)
        ends = np.repeat(first[1:], lengths)
        places = np.arange(len(words))
        known: dict[tuple[int, int], float] = {}

        widened: set[tuple[int, int, int]] = set()

        def verify(text: int, item: int, begin: int) -> None:
            if (begin, item) in known:
                return
            n, last = len(self.words[item]), int(first[text + 1])
            like = known[begin, item] = self.similarity(item, words[begin : min(begin + n, last)])
            if like < least and like >= 0.4 * least and n >= self.k:
                # inserted and deleted words shift the rest
                at, end = max(int(first[text]), begin - n // 2), min(last, begin + n + n // 2)
                if (text, item, begin // max(1, n // 4)) in widened:
                    return
                widened.add((text, item, begin // max(1, n // 4)))
                skip, size = self.best_window(item, words[at:end], least)
                begin = at + skip
                like = self.similarity(item, words[begin : begin + size])
            if like >= least and like > best.get((text, item), (0.0, 0))[0]:
                best[text, item] = (like, begin - int(first[text]))

        for c, of in self.classes.items():
            spans = []
            if len(words) >= c:
                prints = self.prints_of(sums, c)
                fits = np.flatnonzero(places[: len(prints)] + c <= ends[: len(prints)])
                spans.append((fits, prints[fits]))
            # a text somewhat shorter than the class is one window
            short = np.flatnonzero((lengths < c) & (lengths >= max(1, int(0.7 * c))))
            if len(short):
                packed = np.packbits(sums[first[short + 1]] - sums[first[short]] > 0, axis=1).view(U).ravel()
                spans.append((first[short], packed))
            for at, prints in spans:
                left, right = self.candidates(c, prints)
                for p, f in zip(at[left].tolist(), right.tolist(), strict=True):
                    item = int(of["item"][f])
                    text = int(np.searchsorted(first, p, "right")) - 1
                    begin = max(int(first[text]), p - int(of["offset"][f]))
                    verify(text, item, begin)
        for text, item, begin in self.anchored(words, first):
            verify(text, item, begin)
        return best


def _statistics(rows: DataFrame, k: int = 5) -> Statistics:
    """Of all items (item_id, text), counted where they are; what comes back are words and shingles of two items at least."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _text.pieces(b):
                hashes, first = _text.word_hashes(*_text.buffers(piece.column("text")))
                values, at = _text.shingles(hashes, first, k)
                n = np.flatnonzero(np.diff(first) > 0)
                found = [(0, np.zeros(len(n), U)), *((1, np.unique(hashes[first[i] : first[i + 1]])) for i in n), *((2, np.unique(values[at[i] : at[i + 1]])) for i in n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([kind for kind, _ in found], [len(x) for _, x in found]), pa.int64()), pa.array(np.concatenate([x for _, x in found]).view(np.int64))], ["kind", "value"])

    counted = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(parts, "kind long, value long").groupBy("kind", "value").count().filter("kind = 0 or count > 1").toArrow()
    kind, value, count = (counted.column(c).to_numpy() for c in ("kind", "value", "count"))
    of = []
    for x in (1, 2):
        order = np.argsort(value[kind == x].view(U))
        of += [value[kind == x].view(U)[order], count[kind == x][order]]
    return Statistics(int(count[kind == 0].sum()), *of)


def _item_groups(benchmark: DataFrame, most_items: int) -> Iterator[Items]:
    """The items in groups of about `most_items`, so that what goes to every task has a bound; weights are those of all items."""
    rows = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    groups = max(1, -(-rows.count() // most_items))
    whole = _statistics(rows) if groups > 1 else None
    for g in range(groups):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).select("item_id", F.col("text").cast("string")).collect()
        yield Items([r[0] for r in part], [r[1] for r in part], whole=whole)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, most_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): each item that a document contains, at its best window.

    Null and empty texts contain nothing, null or blank items are left out, repeated documents and items are each
    reported, an empty table on either side gives no rows; other columns are ignored, and ids may be of any type that
    Arrow has. Nothing is shuffled.
    """
    id_type, item_type = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    arrow_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark, out = docs.sparkSession, None
    for items in _item_groups(benchmark, most_items):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece in _text.pieces(b, most=PIECE):
                    found = shared.value.leaks(*_text.word_hashes(*_text.buffers(piece.column("text"))), least)
                    who = piece.column("doc_id")
                    keys = sorted(found)
                    yield pa.RecordBatch.from_arrays(
                        [who.take(pa.array([t for t, _ in keys], pa.int64())), pa.array([shared.value.ids[i] for _, i in keys], arrow_type), pa.array([found[k][1] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.float64())],
                        ["doc_id", "item_id", "start_word", "similarity"],
                    )

        part = rows.mapInArrow(_text.tidied(run, 200), f"doc_id {id_type}, item_id {item_type}, start_word long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, most_items: int = 20_000) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Null and empty texts contain nothing and stay, repeated rows are judged alike, an empty benchmark keeps all.
    """
    spark, (whole,) = docs.sparkSession, free(docs.columns, "__text")
    for items in _item_groups(benchmark, most_items):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece in _text.pieces(b, whole, PIECE):
                    found = shared.value.leaks(*_text.word_hashes(*_text.buffers(piece.column(whole))), least)
                    keep = np.ones(piece.num_rows, bool)
                    keep[[t for t, _ in found]] = False
                    yield piece.drop_columns(whole).filter(pa.array(keep))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        docs = docs.withColumn(whole, F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(_text.tidied(run, 200), kinds)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word and similarity of each leak of `benchmark` into `documents`, see find_leaks."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
