"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the beginnings of its words (4 and 6 letters), A-Z folded, hashed to a fixed number
of slots. The machine has a weight and a short vector for each slot that the training rows tie to the label; the
vectors' products give each pair of terms a weight of its own, so an insult beside a group's name can count for more
than both alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import _text
from terralens.llm._tables import Scratch, free, table, texts

SLOTS = 1 << 18


@dataclass(frozen=True)
class Machine:
    """slots: the slots in use, sorted; weight and vectors: one row each; bias."""

    slots: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    bias: float

    def scores(self, term_lists: Iterator[np.ndarray]) -> np.ndarray:
        place = np.full(SLOTS, -1, np.int32)
        place[self.slots] = np.arange(len(self.slots))
        out = []
        for terms in term_lists:
            k = place[terms]
            k = k[k >= 0]
            v = self.vectors[k]
            pairs = 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
            z = self.bias + float(self.weight[k].sum()) + pairs
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return np.array(out, np.float64)


def term_slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """For each text the sorted slots of its distinct terms."""
    for piece in _text.pieces(batch):
        hashes, first = _text.word_hashes(*_text.buffers(piece.column("text")), starts_of=(4, 6))
        slots = (_text.mix(hashes + np.arange(3, dtype=np.uint64)[:, None]) >> np.uint64(64 - 18)).astype(np.int32)
        for i in range(piece.num_rows):
            yield np.unique(slots[:, first[i] : first[i + 1]])


def choose_slots(slots: np.ndarray, with_0: np.ndarray, with_1: np.ndarray, negative: int, positive: int, most_slots: int) -> np.ndarray:
    """The slots, sorted, with the largest log-likelihood ratio of their two-by-two table against the label."""
    n, both = negative + positive, with_0 + with_1
    cells = np.stack([with_1, with_0, positive - with_1, negative - with_0])
    expected = np.stack([both * positive / n, both * negative / n, (n - both) * positive / n, (n - both) * negative / n])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * np.nansum(np.where(cells > 0, cells * np.log(cells / expected), 0), 0)
    gain[both < 2] = 0
    best = np.lexsort((slots, -gain))[:most_slots]
    return np.sort(slots[best[gain[best] > 6.6]])


def fit(x: np.ndarray, labels: np.ndarray, slots: np.ndarray, rank: int = 6, steps: int = 250, seed: int = 7, most_weight: float = 4.0) -> Machine:
    """Fits the machine to rows of 0/1 marks for the slots and 0/1 labels; without both labels or slots it says the share of 1.

    Rows of the rarer label weigh more, up to `most_weight`, so that one telling term can be enough where training rows
    mostly have several.
    """
    n, positive = len(labels), int(labels.sum())
    base = math.log((positive + 0.5) / (n - positive + 0.5))
    if not 0 < positive < n or not len(slots):
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)), base)
    rng = np.random.default_rng(seed)
    params = [np.zeros(len(slots), np.float32), rng.normal(0, 0.02, (len(slots), rank)).astype(np.float32), np.full(1, base, np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    y = labels.astype(np.float32)
    heavier = np.clip(np.where(y == 1, (n - positive) / positive, positive / (n - positive)), 1, most_weight)
    heavier = (heavier / heavier.sum()).astype(np.float32)
    decay = (2e-4, 2e-3, 0.0)
    for step in range(1, steps + 1):
        w, v, b = params
        xv = x @ v
        z = b + x @ w + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * heavier
        grads = [x.T @ error, x.T @ (error[:, None] * xv) - (x.T @ error)[:, None] * v, error.sum(keepdims=True)]
        for p, g, m, d in zip(params, grads, moments, decay, strict=True):
            g = g + d * p / 10
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    w, v, b = (p.astype(np.float64) for p in params)
    return Machine(slots.astype(np.int64), w, v, float(b[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 12_000, held_out: int = 5, most_slots: int = 768) -> Machine:
    """Learns from labelled rows whose crc32(doc_id as text) mod `held_out` is not 0.

    From at most `max_labelled` rows, chosen by a hash of doc_id and text; a row brings at most `most_slots` slots, and
    one task fits the machine to these, so memory has a bound whatever the labels and texts are. Counts of slots come
    from the same rows. Null labels and null ids are left out; a doc_id labelled more than once has its highest label;
    rows that repeat a doc_id and text count once. Without rows the machine says 0.5.
    """
    scratch = Scratch(docs.sparkSession, "machine")
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % held_out != 0))
        .groupBy(F.col("doc_id").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    share = lambda n: F.lit(int(min(1.0, max_labelled / max(n, 1)) * 1_000_000))
    known = scratch.put(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share(known.count())), "known")
    # the labels are about max_labelled here, so they may go to every task; rows that repeat a doc_id are thinned as well
    rows = docs.select("doc_id").join(F.broadcast(known), "doc_id").count()
    row = F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row")
    picked = texts(docs, "doc_id").join(F.broadcast(known), "doc_id").select("label", "text", row).filter(F.pmod(F.col("row"), F.lit(1_000_000)) < share(rows))
    # one row of each hash; its text is read and cut into terms once
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("label"), pa.array([t.astype("<i4").tobytes() for t in term_slots(b)], pa.binary())], ["row", "label", "terms"])

    terms = scratch.put(picked.dropDuplicates(["row"]).mapInArrow(_text.tidied(cut), "row long, label int, terms binary"), "terms")
    # the pick itself: the least ones
    chosen = scratch.put(terms.select("row", "label").orderBy("row").limit(max_labelled), "chosen")
    n, positive = chosen.agg(F.count(F.lit(1)), F.sum("label")).first()
    used = terms.join(F.broadcast(chosen.select("row")), "row")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [np.zeros(SLOTS, np.int64) for _ in range(2)]
        for b in batches:
            for y, t in zip(b.column("label").to_pylist(), b.column("terms").to_pylist(), strict=True):
                of[int(y > 0)][np.frombuffer(t, "<i4")] += 1
        slots = np.flatnonzero(of[0] + of[1])
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(of[0][slots]), pa.array(of[1][slots])], ["slot", "with_0", "with_1"])

    found = used.mapInArrow(counts, "slot long, with_0 long, with_1 long").groupBy("slot").agg(F.sum("with_0").alias("with_0"), F.sum("with_1").alias("with_1")).toArrow()
    slots = np.zeros(0, np.int64)
    if n:
        slots = choose_slots(*(found.column(c).to_numpy() for c in ("slot", "with_0", "with_1")), n - positive, positive, most_slots)
    del found

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(SLOTS, -1, np.int32)
        place[slots] = np.arange(len(slots))
        for b in batches:
            marked = [k[k >= 0].tobytes() for k in (place[np.frombuffer(t, "<i4")] for t in b.column("terms").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("label"), pa.array(marked, pa.binary())], ["row", "label", "marks"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {r: (y, np.frombuffer(m, np.int32)) for b in batches for r, y, m in zip(*(b.column(c).to_pylist() for c in ("row", "label", "marks")), strict=True)}
        x = np.zeros((len(rows), len(slots)), np.float32)
        for i, r in enumerate(sorted(rows)):
            x[i, rows[r][1]] = 1
        m = fit(x, np.array([rows[r][0] > 0 for r in sorted(rows)], np.int64), slots)
        parts = [m.slots.astype("<i8").tobytes(), m.weight.astype("<f8").tobytes(), m.vectors.astype("<f8").tobytes()]
        yield pa.RecordBatch.from_arrays([*(pa.array([p], pa.binary()) for p in parts), pa.array([m.bias])], ["slots", "weight", "vectors", "bias"])

    got = used.mapInArrow(marks, "row long, label int, marks binary").coalesce(1).mapInArrow(_text.tidied(fitted), "slots binary, weight binary, vectors binary, bias double").collect()
    scratch.drop_all_but()
    _text.release()
    if not got:
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 6)), 0.0)
    weight = np.frombuffer(got[0]["weight"], "<f8")
    return Machine(np.frombuffer(got[0]["slots"], "<i8"), weight, np.frombuffer(got[0]["vectors"], "<f8").reshape(len(weight), -1 if len(weight) else 6), got[0]["bias"])


def score(docs: DataFrame, machine: Machine, *keep: str, name: str = "score") -> DataFrame:
    """The named columns and the score (0 to 1, in column `name`) of each row; null texts count as empty, empty ones get the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most most_slots rows
    (whole,) = free([*docs.columns, name], "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b.column(c) for c in keep]
            filled = pa.RecordBatch.from_arrays([b.column(whole)], ["text"])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shared.value.scores(term_slots(filled)), pa.float64())], [*keep, name])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(whole)).mapInArrow(_text.tidied(run), f"{kinds}, `{name}` double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `documents`; a null doc_id is never held out and never trains."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the machine doesn't reject (score under 0.5), with their columns.

    Null and empty texts have the bias's score; rows that repeat are judged alike; an empty table gives none.
    """
    (name,) = free(docs.columns, "__toxicity")
    scored = score(docs, train(docs, labels), *docs.columns, name=name)
    return scored.filter(F.col(name) < 0.5).drop(name)
