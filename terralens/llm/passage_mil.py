"""Document quality by attention over passages, learnt from document labels only.

A text is cut into passages of 64 words (the last one shorter; a text without words is one passage). A passage becomes a
vector: shares of its bytes, shapes of its words, repeats among them, and its words hashed to signed slots. A hidden layer
h, a gated attention a ~ softmax over the text's passages of w · (tanh(V h) * sigmoid(U h)), and a logistic unit on the
sum of a h are learnt together (multiple-instance learning): a few bad passages can decide about a long text, and a
passage's weight says which ones did.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import _text
from terralens.llm._tables import Scratch, free, table, texts

WORDS, SLOTS, HIDDEN, GATE = 64, 128, 32, 16
_BYTES = 130  # ASCII by byte, first bytes of other characters, their further bytes
_SHAPES = 14
WIDTH = _BYTES + _SHAPES + SLOTS
_KIND = np.full(256, 5, np.int64)  # 0 lower, 1 upper, 2 digit, 3 stop, 4 other sign, 5 beyond ASCII
_KIND[:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[list(b".,;:!?'\"()")] = 3
_CLASS = np.arange(256)
_CLASS[128:192], _CLASS[192:] = 129, 128


def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all passages of texts that lie one behind the other, and the number of each text's first one (one more at the end)."""
    n_texts = len(at) - 1
    hashes, first = _text.word_hashes(data, at)
    blank = _text.is_space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    opens, closes = ~blank, ~blank
    opens[1:] &= blank[:-1] | edge[1 : len(data)]
    closes[:-1] &= blank[1:] | edge[1 : len(data)]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = np.diff(first)
    many = np.maximum(1, -(-words // WORDS))
    top = np.zeros(n_texts + 1, np.int64)
    np.cumsum(many, out=top[1:])
    n = int(top[-1])
    owner = np.repeat(np.arange(n_texts), words)
    of_word = top[:-1][owner] + (np.arange(len(starts)) - first[:-1][owner]) // WORDS
    # a passage holds the bytes from its first word (a text's first passage: from the text's beginning) to the next passage
    begins = at[:-1][np.repeat(np.arange(n_texts), many)].copy()
    heads = np.flatnonzero(np.diff(of_word, prepend=-1))
    later = of_word[heads] > top[:-1][owner[heads]] if len(heads) else np.zeros(0, bool)
    begins[of_word[heads[later]]] = starts[heads[later]]
    of_byte = np.repeat(np.arange(n), np.diff(np.append(begins, len(data))))
    out = np.zeros((n, WIDTH), np.float32)
    size = np.maximum(1, np.bincount(of_byte, minlength=n)).astype(np.float32)
    out[:, :_BYTES] = np.sqrt(np.bincount(of_byte * _BYTES + _CLASS[data], minlength=n * _BYTES).reshape(n, _BYTES) / size[:, None])
    count = np.bincount(of_word, minlength=n).astype(np.float32)
    some = np.maximum(1, count)
    shape = out[:, _BYTES : _BYTES + _SHAPES]
    if len(starts):
        for k, place in enumerate((starts, ends - 1)):
            shape[:, 5 * k : 5 * k + 5] = np.bincount(of_word * 6 + _KIND[data[place]], minlength=6 * n).reshape(n, 6)[:, :5] / some[:, None]
        shape[:, 10] = np.log1p(np.bincount(of_word, ends - starts, n) / some)
        order = np.lexsort((hashes, of_word))
        new = (np.diff(of_word[order], prepend=-1) != 0) | (np.diff(hashes[order], prepend=hashes[order][:1]) != 0)
        shape[:, 11] = np.bincount(of_word[order], new, n) / some
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        shape[:, 12] = np.bincount(of_word, again, n) / some
        shape[:, 13] = count / WORDS
        slot = (hashes >> np.uint64(64 - 7)).astype(np.int64)
        sign = 1.0 - 2.0 * ((hashes >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
        out[:, _BYTES + _SHAPES :] = np.bincount(of_word * SLOTS + slot, sign, n * SLOTS).reshape(n, SLOTS) / np.sqrt(some)[:, None]
    return out, top


@dataclass(frozen=True)
class Model:
    """mean and scale of the inputs; W, b: hidden layer; V, U, w: gated attention; c, d: the logistic unit."""

    mean: np.ndarray
    scale: np.ndarray
    parts: tuple[np.ndarray, ...]

    def forward(self, x: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logits of the texts, the passages' weights, and what the gradient needs."""
        W, b, V, U, w, c, d = self.parts
        h = np.tanh(((x - self.mean) * self.scale).clip(-6, 6) @ W + b)
        t, s = np.tanh(h @ V), 1 / (1 + np.exp(-(h @ U)))
        e = (t * s) @ w
        of = np.repeat(np.arange(len(top) - 1), np.diff(top))
        a = np.exp(e - np.maximum.reduceat(e, top[:-1])[of])
        a /= np.add.reduceat(a, top[:-1])[of]
        z = np.add.reduceat(a[:, None] * h, top[:-1], axis=0)
        return z @ c + d[0], a, h, t, s, of, z

    def scores(self, x: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' scores and the passages' weights, in double precision and to nine places, so that they don't depend on a text's neighbours."""
        if len(top) < 2:
            return np.zeros(0), np.zeros(0)
        fine = Model(self.mean.astype(np.float64), self.scale.astype(np.float64), tuple(p.astype(np.float64) for p in self.parts))
        y, a, *_ = fine.forward(x.astype(np.float64), top)
        return np.round(1 / (1 + np.exp(-y.clip(-60, 60))), 9), a


def constant(share: float) -> Model:
    """Says the same for every text; where no labels, or only equal ones, were given."""
    zero = (np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, GATE)), np.zeros((HIDDEN, GATE)), np.zeros(GATE), np.zeros(HIDDEN), np.full(1, np.log(share / (1 - share))))
    return Model(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), tuple(p.astype(np.float32) for p in zero))


def gradient(model: Model, x: np.ndarray, top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted logistic loss by each part of the model, in its order."""
    _, _, V, U, w, c, _ = model.parts
    logit, a, h, t, s, of, z = model.forward(x, top)
    error = (1 / (1 + np.exp(-logit.clip(-30, 30))) - y) * weight
    dz = error[:, None] * c  # by each text's sum
    da = (h * dz[of]).sum(1)
    de = a * (da - np.add.reduceat(a * da, top[:-1])[of])
    dgate = de[:, None] * w
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    dh = a[:, None] * dz[of] + dt @ V.T + ds @ U.T
    dx = dh * (1 - h * h)
    inputs = ((x - model.mean) * model.scale).clip(-6, 6)
    return [inputs.T @ dx, dx.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ error, error.sum(keepdims=True)]


def fit(x: np.ndarray, top: np.ndarray, labels: np.ndarray, epochs: int = 30, batch: int = 128, seed: int = 13, most_weight: float = 3.0) -> Model:
    """Learns from texts (their passages' vectors x, cut at top) and 0/1 labels; rows of the rarer label weigh up to most_weight."""
    n, positive = len(labels), int(labels.sum())
    if not 0 < positive < n:
        return constant((positive + 0.5) / (n + 1))
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
    parts = [small(WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), small(HIDDEN, GATE), small(HIDDEN, GATE), small(GATE), small(HIDDEN), np.zeros(1, np.float32)]
    spread = x.std(0)
    scale = np.where(spread > 1e-4, 1 / np.maximum(spread, 0.02), 0).astype(np.float32)
    model = Model(x.mean(0).astype(np.float32), scale, tuple(parts))
    y = labels.astype(np.float32)
    weight = np.clip(np.where(y == 1, (n - positive) / positive, positive / (n - positive)), 1, most_weight).astype(np.float32)
    moments, step, decay = [[np.zeros_like(p), np.zeros_like(p)] for p in parts], 0, (1e-3, 0, 1e-3, 1e-3, 1e-3, 1e-3, 0)
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 2e-4
        order = rng.permutation(n)
        for begin in range(0, n, batch):
            rows = order[begin : begin + batch]
            many = top[rows + 1] - top[rows]
            at = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(many, out=at[1:])
            take = np.repeat(top[rows] - at[:-1], many) + np.arange(at[-1])
            step += 1
            for p, g, m, k in zip(parts, gradient(model, x[take], at, y[rows], weight[rows] / len(rows)), moments, decay, strict=True):
                g = g + k * p
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece in _text.pieces(b):
            x, top = encode(*_text.buffers(piece.column("text")))
            blobs = [x[top[i] : top[i + 1]].astype("<f2").tobytes() for i in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("label"), pa.array(np.diff(top)), pa.array(blobs, pa.binary())], ["row", "label", "passages", "vectors"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 6_000, max_passages: int = 60_000, held_out: tuple[int, int] = (3, 1)) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod held_out[0] is not held_out[1].

    From at most `max_labelled` rows with `max_passages` passages in all, taken by a hash of doc_id and text in its order (a
    row that would pass the second bound is left out, whole); one task fits them. Null labels and ids are left out; a doc_id
    labelled more than once has its highest label; rows that repeat a doc_id and text count once. Without rows the model
    says 0.5, with one label only the share of it (half a row added to each).
    """
    scratch, thousandths = Scratch(docs.sparkSession, "passages"), 1_000_000
    learns = F.crc32(F.col("doc_id").cast("string")) % held_out[0] != held_out[1]
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learns).groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = lambda n: F.lit(int(min(1.0, 1.1 * max_labelled / max(n, 1)) * thousandths))
    known = scratch.put(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(thousandths)) < share(known.count())), "known")
    # about max_labelled labels are left, so they may go to every task; rows that share a doc_id are thinned as well
    rows = docs.select("doc_id").join(F.broadcast(known), "doc_id").count()
    row = F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row")
    picked = texts(docs, "doc_id").join(F.broadcast(known), "doc_id").select("label", "text", row).filter(F.pmod(F.col("row"), F.lit(thousandths)) < share(rows))
    encoded = scratch.put(picked.dropDuplicates(["row"]).mapInArrow(_text.tidied(_vectors), "row long, label int, passages long, vectors binary"), "encoded")
    chosen, left = [], max_passages
    for r, n in encoded.select("row", "passages").orderBy("row").limit(max_labelled).collect():
        if n <= left:
            chosen.append((r,))
            left -= n
    if not chosen:
        scratch.drop_all_but()
        return constant(0.5)
    used = encoded.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "row long")), "row")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {r: (y, v) for b in batches for r, y, v in zip(*(b.column(c).to_pylist() for c in ("row", "label", "vectors")), strict=True)}
        order = sorted(found)
        each = [np.frombuffer(found[r][1], "<f2").reshape(-1, WIDTH) for r in order]
        top = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(v) for v in each], out=top[1:])
        model = fit(np.concatenate(each).astype(np.float32), top, np.array([found[r][0] > 0 for r in order], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = used.select("row", "label", "vectors").coalesce(1).mapInArrow(_text.tidied(fitted), "model binary").first()
    scratch.drop_all_but()
    return pickle.loads(bytes(got[0]))


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """The named columns and the score (0 to 1, in column `name`) of each row's whole text; null texts count as empty ones, which are one passage without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 12,000 numbers
    (whole,) = free([*docs.columns, name], "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _text.pieces(b, whole):
                scores, _ = shared.value.scores(*encode(*_text.buffers(piece.column(whole))))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, name])

    if name in keep:
        raise ValueError(f"the column {name} is taken")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(whole)).mapInArrow(_text.tidied(run), f"{kinds}, `{name}` double")


def op13_passage_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `documents`; a null doc_id is never held out and never trains.

    Null and empty texts have a score too; repeated rows have equal ones; an empty table gives no rows; ids with equal texts tie.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
