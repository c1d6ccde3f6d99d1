"""Katz backoff models: Good-Turing discounts, exactly normalised backoff weights, scores of whole texts.

P(w | h) = d(c(hw)) c(hw) / c(h) where hw occurs in training, else alpha(h) P(w); P(w) = d(c(w)) c(w) / N for known words,
and what the discounts leave is the probability of an unknown word. alpha(h) = (1 - sum of the seen P(w | h)) / (1 - sum
of the seen words' P(w)), so each history's probabilities sum to one. Counts up to 5 have Katz's Good-Turing discounts;
larger ones lose half a count, so that every history leaves something for unseen words.

The model never is in one place. Tokens are dealt by a hash of the word (frequent words, whose counts all tasks know, by
one of the word and its history), packed in blocks of documents: there c(w) and c(hw) are complete, and each document's terms that depend on them are summed. The history's count needs no second trip,
for it is the word's own count where the word stands, a place earlier. Only unseen bigrams (of held-out documents) ask
for their history's backoff weight; the tables of histories are dealt by a hash of the history and answer them there.
Histories go by 48 bits of their words' hashes. Good-Turing's counts of counts of bigrams are known only at the end, so sums keep the number of bigrams with each small
count, and the discounts come in when all is added up.

That is score(), a bigram model of the documents that it scores. learn() writes tables of any order, three by default, and
evaluate() scores other documents with them, recursively: P(w | uv) = its own probability, or alpha(uv) P(w | v).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import _text
from terralens.llm._tables import Scratch, freed, table, texts, written

U = np.uint64
SMALL = 5  # counts with a Good-Turing discount
TAIL = 0.5  # what larger counts lose
BEGIN, END = U(0xA5A5A5A5A5A5A5A5), U(0x5C5C5C5C5C5C5C5C)
#: A part's words are worked on in this many slices, one after the other, so that memory holds one slice's numbers.
_SLICES = 6
#: A part has up to so many units of _SLICES slices each: what it finds of a document travels once, not once a unit.
_UNITS = 8
#: Documents whose sums a part holds at a time.
_HELD_DOCS = 1 << 21
_BLOCK_DOCS = 60_000  # their places fit 16 bits


#: Words that every task may know the count of.
_MOST_HOT = 1_000_000


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """d(1) .. d(SMALL) from the numbers of types that occur 1 .. SMALL + 1 times.

    Katz's formula; where it gives nothing between 0 and 1 (few data), (r - TAIL) / r.
    """
    n = np.concatenate([[0.0], of_counts.astype(float)])
    out = np.empty(SMALL)
    tail = (SMALL + 1) * n[SMALL + 1] / n[1] if n[1] else 1.0
    for r in range(1, SMALL + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r - 1] = d if 0.02 < d < 1 else (r - TAIL) / r
    return out


@dataclass(frozen=True)
class Unigrams:
    """What all tasks need of the training tokens: a few numbers."""

    tokens: int
    distinct: int
    documents: int
    discount: np.ndarray  # of counts 1 .. SMALL
    known: float  # the known words' share of probability
    hot: np.ndarray  # frequent words, sorted, which are dealt by their history as well
    hot_counts: np.ndarray

    def is_hot(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hot, and the places of these."""
        if not len(self.hot):
            return np.zeros(len(words), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        hit = self.hot[at] == words
        return hit, at[hit]

    def probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with training count c > 0."""
        d = np.where(c <= SMALL, self.discount[np.clip(c, 1, SMALL) - 1] * c, c - TAIL)
        return d / max(1, self.tokens)


def _blocks(batches: Iterator[pa.RecordBatch], first_block: int, block_tokens: int) -> Iterator[tuple]:
    """(block, rows, history, word, document of each token): documents packed up to a bounded number of tokens.

    Training documents come first in a block; rows are (doc_id, held_out, n_tokens), n_train says how many train.
    """
    held: list = []
    tokens = 0
    k = 0

    def packed() -> tuple:
        nonlocal k
        held.sort(key=lambda x: x[1])
        words = [np.append(w, END) for _, _, w in held]
        n = np.array([len(w) for w in words], np.int64)
        word = np.concatenate(words)
        history = np.empty_like(word)
        history[1:] = word[:-1] >> U(16)
        history[np.cumsum(n) - n] = BEGIN >> U(16)
        out = (first_block + k, [(i, h, len(w) + 1) for i, h, w in held], sum(not h for _, h, _ in held), history, word, np.repeat(np.arange(len(held)), n))
        k += 1
        held.clear()
        return out

    for b in batches:
        for piece in _text.pieces(b):
            hashes, first = _text.word_hashes(*_text.buffers(piece.column("text")))
            for i, (doc_id, out) in enumerate(zip(piece.column("doc_id").to_pylist(), piece.column("held_out").to_pylist(), strict=True)):
                held.append((doc_id, out, hashes[first[i] : first[i + 1]]))
                tokens += int(first[i + 1] - first[i]) + 1
                if tokens >= block_tokens or len(held) >= _BLOCK_DOCS:
                    yield packed()
                    tokens = 0
    if held:
        yield packed()


def _sliced(part: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The runs of a sorted array of part numbers."""
    at = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(at)):
        yield int(p), slice(int(at[p]), int(at[p + 1]))


# --- counts of words --------------------------------------------------------------------------------------------

_COUNTED = "part int, words binary, counts binary"


def _count_words(batches: Iterator[pa.RecordBatch], parts: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    for _, _, n_train, _, word, doc in _blocks(batches, 0, block_tokens):
        words, counts = np.unique(word[doc < n_train], return_counts=True)
        part = (words % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        words, counts = words[order], counts[order].astype("<u4")
        rows = [(p, words[s].tobytes(), counts[s].tobytes()) for p, s in _sliced(part[order], parts)]
        p, w, c = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(w, pa.binary()), pa.array(c, pa.binary())], ["part", "words", "counts"])


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at = np.unique(words, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.int64)


def _word_statistics(group: pa.Table, hot_from: int) -> pa.Table:
    """(r, n, word): the types that occur r times for r to SMALL + 1; all types at 0; all tokens at -1; each word that occurs `hot_from` times at -2."""
    words = np.frombuffer(b"".join(x.as_py() for x in group.column("words")), U)
    counts = np.frombuffer(b"".join(x.as_py() for x in group.column("counts")), "<u4")
    w, c = _summed(words, counts)
    often = c >= hot_from
    r = [-1, 0, *range(1, SMALL + 2), *[-2] * int(often.sum())]
    n = [int(c.sum()), len(c), *(int((c == k).sum()) for k in range(1, SMALL + 2)), *c[often].tolist()]
    return pa.table({"r": pa.array(r, pa.int64()), "n": pa.array(n, pa.int64()), "word": pa.array([None] * (SMALL + 3) + w[often].view(np.int64).tolist(), pa.int64())})


# --- bigrams, dealt by their second word ------------------------------------------------------------------------

#: What _score_slice takes of _SENT.
_SCORED = ["block", "n_train", "words", "of_word", "history", "times", "docs"]
_SENT = "part int, slice int, block long, n_train int, words binary, of_word binary, history binary, times binary, docs binary, ids array<long>, held array<boolean>, n array<long>"


def _send_bigrams(batches: Iterator[pa.RecordBatch], parts: int, uni: Unigrams, block_tokens: int, units: int = 1) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    names = ["part", "slice", "block", "n_train", "words", "of_word", "history", "times", "docs", "ids", "held", "n"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
    for block, rows, n_train, history, word, doc in _blocks(batches, TaskContext.get().partitionId() << 20, block_tokens):
        slices = units * _SLICES
        part = (word % U(parts * slices)).astype(np.int16 if parts * slices < 32_000 else np.int64)
        hot, _ = uni.is_hot(word)
        part[hot] = _text.mix(word[hot] ^ history[hot]) % U(parts * slices)
        order = np.lexsort((history, word, part))
        part, word, history, doc = part[order], word[order], history[order], doc[order].astype("<u2")
        del order
        out = []
        for p, s in _sliced(part, parts * slices):
            w, h = word[s], history[s]
            new_w = np.append(True, w[1:] != w[:-1])
            new = new_w | np.append(True, h[1:] != h[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(w))).astype("<u4")
            first_w = np.flatnonzero(new_w[begin])
            of_word = np.diff(np.append(first_w, len(begin))).astype("<u4")
            out.append((p // slices, p % slices, block, n_train, w[new_w].tobytes(), _short(of_word), _six(h[begin]), _short(times), doc[s].tobytes(), None, None, None))
        ids, held, n = zip(*rows, strict=True)
        out.append((int(block % parts), 0, block, n_train, None, None, None, None, None, list(ids), list(held), list(n)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _short(x: np.ndarray) -> bytes:
    """Counts as bytes; those above 254 follow as four bytes each."""
    big = x >= 255
    return np.array([len(x)], "<u4").tobytes() + np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype("<u4").tobytes()


def _long(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", offset=4 + n)
    return out


def _six(x: np.ndarray) -> bytes:
    """48-bit numbers: all their low bytes, then all second ones and so on."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


#: key: a block or a part; packed numbers by kind, see _score_words.
_ROWS = "kind string, key long, ids binary, ints binary, nums binary"
_INTS = 1 + SMALL  # of a document: known tokens, then bigrams with count 1 .. SMALL
_HISTORY = 2 + SMALL  # of a history: count, followers with count 1 .. SMALL, followers with more


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["kind", "key", "ids", "ints", "nums"])


def _refs(x: np.ndarray) -> bytes:
    return x.astype("<u2").tobytes()  # a block's documents


def _sum_rows(refs: np.ndarray, ints: np.ndarray | None, nums: np.ndarray) -> Iterator[tuple]:
    """A row for each block of the sorted references."""
    block = refs >> 16
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(refs)])
    for b, e in zip(begin, np.append(begin, len(refs))[1:], strict=True):
        yield "sum", int(block[b]), _refs(refs[b:e] & 0xFFFF), None if ints is None else _short(ints[b:e].T.ravel()), np.ascontiguousarray(nums[b:e].T).tobytes()


def _score_words(batches: Iterator[pa.RecordBatch], uni: Unigrams, keys: int) -> Iterator[pa.RecordBatch]:
    """All that a part's words know. Rows by kind:

    sum: of a block, documents, their ints and (base score, score); alpha: of one of so many keys of histories, histories,
    their counts and the sum of their followers' P(w); ask: of such a key, histories and block * 65536 + document; docs: of
    a block, doc_ids and (held out, tokens); stat: counts of counts of bigrams.

    Histories go on after each unit of slices, documents' sums at the end or when there are many, so memory has a bound.
    """
    of_slice: dict[int, list[pa.RecordBatch]] = {}
    for b in batches:
        place = b.column("slice").to_numpy()
        is_docs = b.column("ids").is_valid().to_numpy(zero_copy_only=False)
        out = []
        for r in b.filter(pa.array(is_docs)).select(["block", "ids", "held", "n"]).to_pylist():
            flat = np.empty(2 * len(r["n"]), np.int64)
            flat[::2], flat[1::2] = r["held"], r["n"]
            # a null doc_id cannot be a number of the list: it is marked in the token count's sign
            null = np.array([i is None for i in r["ids"]])
            flat[1::2][null] *= -1
            out.append(("docs", r["block"], np.array([0 if i is None else i for i in r["ids"]], np.int64).tobytes(), flat.tobytes(), None))
        if out:
            yield _batch(out)
        for k in np.unique(place[~is_docs]).tolist():
            of_slice.setdefault(k, []).append(b.select(_SCORED).filter(pa.array(~is_docs & (place == k))))
    sums = none = (np.zeros(0, np.int64), np.zeros((0, _INTS), np.int32), np.zeros((0, 2)))
    for unit in sorted({k // _SLICES for k in of_slice}):
        out, asks, histories = [], [], []
        for k in range(unit * _SLICES, (unit + 1) * _SLICES):
            if k in of_slice:
                blocks = [r for b in of_slice.pop(k) for r in b.to_pylist()]
                new, asked = _score_slice(blocks, uni, out, histories)
                sums = _merged(sums, new)
                asks += asked
                del blocks, new, asked
                _text.release()
        yield _batch(out)
        yield from _few_rows(_history_rows(histories, keys))
        del histories
        if asks:
            of_h, ref = (np.concatenate(x) for x in zip(*asks, strict=True))
            part = ((of_h >> U(20)) % U(keys)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            of_h, ref = of_h[order], ref[order]
            yield from _few_rows(("ask", p, _six(of_h[s]), ref[s].tobytes(), None) for p, s in _sliced(part[order], keys))
        if len(sums[0]) > _HELD_DOCS:
            yield from _few_rows(_sum_rows(*sums))
            sums = none
        _text.release()
    yield from _few_rows(_sum_rows(*sums))
    _text.release()


def _few_rows(rows: Iterator[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, most)):
        yield _batch(some)


def _merged(a: tuple, b: tuple) -> tuple:
    """Two sets of documents' sums as one."""
    ref, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    ints, nums = np.zeros((len(ref), _INTS), np.int32), np.zeros((len(ref), 2))
    for part, where in ((a, at[: len(a[0])]), (b, at[len(a[0]) :])):
        ints[where] += part[1]
        nums[where] += part[2]
    return ref, ints, nums


def _score_slice(blocks: list[dict], uni: Unigrams, out: list, histories: list) -> tuple[tuple, list]:
    """Sums of documents and what they ask for, from the rows of one slice; counts go to out and histories."""
    word = np.concatenate([np.repeat(np.frombuffer(r["words"], U), _long(r["of_word"])) for r in blocks])
    history = np.concatenate([_from_six(r["history"]) for r in blocks])
    trained, times = [], []
    for r in blocks:
        n = _long(r["times"])
        doc = np.frombuffer(r["docs"], "<u2")
        trained.append(np.add.reduceat((doc < r["n_train"]).astype(np.int64), np.cumsum(n) - n))
        times.append(n)
    order = np.lexsort((history, word))
    w, h, c = word[order], history[order], np.concatenate(trained)[order]
    new_w = np.append(True, w[1:] != w[:-1])
    new = new_w | np.append(True, h[1:] != h[:-1])
    begin, begin_w = np.flatnonzero(new), np.flatnonzero(new_w)
    pair_count, word_count = np.add.reduceat(c, begin), np.add.reduceat(c, begin_w)
    hot, at = uni.is_hot(w[begin_w])
    word_count[hot] = uni.hot_counts[at]  # only some of their histories are here
    per_pair, per_word = np.cumsum(new) - 1, np.cumsum(new_w) - 1
    with np.errstate(divide="ignore"):
        p_word = np.where(word_count > 0, uni.probability(word_count), 1.0 - uni.known)
        # histories: what their followers here add up to
        seen = pair_count > 0
        of_c = pair_count[seen]
        histories.append(_history_sums(h[begin][seen], of_c, p_word[per_word[begin]][seen]))
        out.append(("stat", 0, None, np.bincount(np.clip(of_c, 0, SMALL + 2), minlength=SMALL + 3)[1 : SMALL + 2].astype(np.int64).tobytes(), None))
        # terms of a bigram, then of the rows as they came
        base_w = np.log10((word_count + 1.0) / (uni.tokens + uni.distinct + 1.0))
        own_w = np.where((word_count > 0) & (w[begin_w] != END), -np.log10(np.maximum(word_count, 1)), 0.0)
        of_pair = per_word[begin]
        term_p = own_w[of_pair] + np.where(pair_count > SMALL, np.log10(np.maximum(pair_count - TAIL, TAIL)), np.where(seen, np.log10(np.maximum(pair_count, 1)), np.log10(p_word[of_pair])))
    c_pair, base, term, known = np.empty(len(w), np.int64), np.empty(len(w)), np.empty(len(w)), np.empty(len(w), bool)
    c_pair[order], base[order], term[order], known[order] = pair_count[per_pair], base_w[per_word], term_p[per_pair], (word_count > 0)[per_word]
    at, found, asks = 0, [], []
    for r, n in zip(blocks, times, strict=True):
        doc = np.frombuffer(r["docs"], "<u2").astype(np.int64)
        pair = at + np.repeat(np.arange(len(n)), n)
        at += len(n)
        docs, place = np.unique(doc, return_inverse=True)
        ints = np.zeros((len(docs), _INTS), np.int32)
        ints[:, 0] = np.bincount(place[known[pair]], minlength=len(docs))
        few = c_pair[pair]
        for k in range(1, SMALL + 1):
            ints[:, k] = np.bincount(place[few == k], minlength=len(docs))
        nums = np.stack([np.bincount(place, base[pair], len(docs)), np.bincount(place, term[pair], len(docs))], 1)
        found.append(((r["block"] << 16) + docs, ints, nums))
        if len(lone := np.flatnonzero(few == 0)):
            asks.append((history[pair[lone]], (r["block"] << 16) + doc[lone]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)), asks


def _history_sums(h: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple:
    """(histories, their counts, sums of P(w)) of distinct bigrams with counts c and second words' P(w)."""
    order = np.argsort(h, kind="stable")
    h, c, p = h[order], c[order], p[order]
    if not len(h):
        return h, np.zeros((0, _HISTORY), np.int32), p
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    ints = np.empty((len(begin), _HISTORY), np.int32)  # a part's tokens are far fewer than 2**31
    ints[:, 0] = np.add.reduceat(c, begin)
    for r in range(1, SMALL + 1):
        ints[:, r] = np.add.reduceat((c == r).astype(np.int32), begin)
    ints[:, SMALL + 1] = np.add.reduceat((c > SMALL).astype(np.int32), begin)
    return h[begin], ints, np.add.reduceat(p, begin)


def _history_rows(slices: list[tuple], keys: int) -> Iterator[tuple]:
    h = np.concatenate([np.zeros(0, U), *(x[0] for x in slices)])
    part = ((h >> U(20)) % U(keys)).astype(np.int64)
    order = np.lexsort((h, part))
    h, part = h[order], part[order]
    if not len(h):
        return
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    ints = np.add.reduceat(np.concatenate([x[1] for x in slices])[order], begin, axis=0)
    sums = np.add.reduceat(np.concatenate([x[2] for x in slices])[order], begin)
    for k, s in _sliced(part[begin], keys):
        yield "alpha", k, _six(h[begin][s]), _short(ints[s].T.ravel()), sums[s].tobytes()


def _answer(group: pa.Table, pair_discount: np.ndarray) -> pa.Table:
    """Rows of kind sum: log10(alpha(h) c(h)) of every unseen bigram's history, by block and document."""
    hs, ints, ps, asked, refs = [], [], [], [], []
    for r in range(group.num_rows):
        ids = _from_six(group.column("ids")[r].as_py())
        if group.column("kind")[r].as_py() == "alpha":
            hs.append(ids)
            ints.append(_long(group.column("ints")[r].as_py()).astype(np.int32).reshape(_HISTORY, -1).T)
            ps.append(np.frombuffer(group.column("nums")[r].as_py(), np.float64))
        else:
            asked.append(ids)
            refs.append(np.frombuffer(group.column("ints")[r].as_py(), np.int64))
    if not asked:
        return pa.Table.from_batches([_batch([])])
    asked, refs = np.concatenate(asked), np.concatenate(refs)
    value = np.zeros(len(asked))
    if hs:
        h = np.concatenate(hs)
        wanted = np.isin(h, asked)  # few histories are asked for
        h, at = np.unique(h[wanted], return_inverse=True)
        counts = np.concatenate(ints)[wanted]
        total = np.stack([np.bincount(at, counts[:, k], len(h)) for k in range(_HISTORY)], 1)
        p = np.bincount(at, np.concatenate(ps)[wanted], len(h))
        weight = backoff(total, p, pair_discount)
        if len(h):
            place = np.minimum(np.searchsorted(h, asked), len(h) - 1)
            hit = h[place] == asked
            value[hit] = (np.log10(weight) + np.log10(total[:, 0]))[place[hit]]
    ref, at = np.unique(refs, return_inverse=True)
    nums = np.zeros((len(ref), 2))
    nums[:, 1] = np.bincount(at, value, len(ref))
    return pa.Table.from_batches([_batch(list(_sum_rows(ref, None, nums)))])


def backoff(counts: np.ndarray, seen_mass: np.ndarray, pair_discount: np.ndarray) -> np.ndarray:
    """alpha of each history, from its counts (see _HISTORY) and the sum of its followers' P(w)."""
    small = counts[:, 1 : 1 + SMALL]
    lost = small @ ((1 - pair_discount) * np.arange(1, SMALL + 1)) + TAIL * counts[:, 1 + SMALL]
    return lost / counts[:, 0] / np.maximum(1 - seen_mass, 1e-300)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, n) of each batch's stat rows."""
    for b in batches:
        n = sum((np.frombuffer(x.as_py(), np.int64) for x in b.column("ints")), np.zeros(SMALL + 1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(SMALL + 1), pa.int32()), pa.array(n, pa.int64())], ["r", "n"])


def _added_up(group: pa.Table, pair_discount: np.ndarray, uni: Unigrams) -> pa.Table:
    """One row for each document of a block."""
    kinds = group.column("kind").to_pylist()
    values = lambda c, r, kind=np.int64: np.frombuffer(group.column(c)[r].as_py(), kind)
    rows = [r for r, k in enumerate(kinds) if k == "docs"]
    if not rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
    ids, flat = values("ids", rows[0]), values("ints", rows[0]).reshape(-1, 2)
    ints, nums = np.zeros((len(ids), _INTS), np.int64), np.zeros((len(ids), 2))
    for r, k in enumerate(kinds):
        if k == "sum":
            at = values("ids", r, "<u2")
            if (few := group.column("ints")[r].as_py()) is not None:
                ints[at] += _long(few).reshape(_INTS, -1).T
            nums[at] += values("nums", r, np.float64).reshape(2, -1).T
    score = nums[:, 1] + ints[:, 1:] @ np.log10(pair_discount) - (np.log10(uni.documents) if uni.documents else 0.0)
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=flat[:, 1] < 0), "held_out": pa.array(flat[:, 0] == 1), "n_tokens": pa.array(np.abs(flat[:, 1])),
        "n_known": pa.array(ints[:, 0]), "base_score": pa.array(nums[:, 0]), "score": pa.array(score),
    })


def score(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 7 = 2", block_tokens: int = 1_000_000, hot_share: float = 0.25, unit_bytes: int = 20_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Learns from the rows for which `held_out` (SQL) is not true. Tokens are the words (A-Z folded) and one end. n_known
    counts tokens that occur in training, base_score sums log10((c + 1) / (N + V + 1)), score is the model's log10
    probability of the whole text, end included. Null texts are empty (one token), rows with a null doc_id train,
    repeated rows count each time, an empty table gives none; without training rows the only words are unknown, with
    probability 1. Other columns are ignored. The rows must come in the same order when a task is run again (a table
    does). Words go by 64-bit hashes. What is gathered grows with the input and stays dealt out: only the counts of
    counts and of hot words reach the driver; a word is hot with `hot_share` of a unit's tokens, so there are at most
    1 / hot_share of them for each unit. A block has about `block_tokens` tokens, a unit the words of about `unit_bytes` of text.
    """
    spark = docs.sparkSession
    base = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    trains, size = base.agg(F.sum((~F.col("held_out")).cast("long")), F.sum(F.octet_length("text").cast("long"))).first()
    # bounded work in each; a part has some of them, but there are parts for all cores to stay busy
    keys = max(8, -(-int(size or 0) // unit_bytes))
    units = max(1, min(_UNITS, keys // (2 * spark.sparkContext.defaultParallelism)))
    parts = -(-keys // units)
    # about eight bytes a word; beyond a million words a part may be that much larger instead
    hot_from = int(max(hot_share / keys, 1 / _MOST_HOT) * (size or 0) / 8) + 100
    counted = base.mapInArrow(lambda it: _count_words(it, keys, block_tokens), _COUNTED).groupBy("part").applyInArrow(lambda g: _word_statistics(g, hot_from), "r long, n long, word long")
    stats, hot = {}, []
    for r in counted.groupBy("r", "word").agg(F.sum("n").alias("n")).collect():
        if r["word"] is None:
            stats[r["r"]] = r["n"]
        else:
            hot.append((r["word"] & (1 << 64) - 1, r["n"]))
    hot.sort()
    del counted
    freed(spark)
    tokens, of_counts = stats.get(-1) or 0, np.array([stats.get(r) or 0 for r in range(1, SMALL + 2)])
    d = discounts(of_counts)
    small = float((of_counts[:SMALL] * np.arange(1, SMALL + 1)).sum())
    kept = float((of_counts[:SMALL] * np.arange(1, SMALL + 1) * d).sum()) + (tokens - small) - TAIL * ((stats.get(0) or 0) - of_counts[:SMALL].sum())
    uni = Unigrams(tokens, stats.get(0) or 0, trains or 0, d, kept / tokens if tokens else 0.0, np.array([w for w, _ in hot], U), np.array([n for _, n in hot], np.int64))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score_words(batches, uni, keys)

    rows = base.mapInArrow(lambda it: _send_bigrams(it, parts, uni, block_tokens, units), _SENT).groupBy("part").applyInArrow(scored, _ROWS)
    # readers hold a row group's rows at a time
    model = written(rows, "katz", "kind", **{"parquet.block.size": str(32 << 20), "compression": "zstd"})
    del rows
    freed(spark)
    got = model.filter("kind = 'stat'").select("ints").mapInArrow(_stats, "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()
    of_pairs = np.zeros(SMALL + 1, np.int64)
    for r in got:
        of_pairs[r["r"]] = r["n"]
    pair_discount = discounts(of_pairs)
    order = [x.strip().split(" ")[0] for x in _ROWS.split(",")]
    asked = model.filter("kind in ('alpha', 'ask')").select(order).groupBy("key").applyInArrow(lambda g: _answer(g, pair_discount), _ROWS)
    sums = model.filter("kind in ('sum', 'docs')").select(order).unionByName(asked)
    out = sums.groupBy("key").applyInArrow(lambda g: _added_up(g, pair_discount, uni), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


# --- stored tables of any order ------------------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _tokens(docs: DataFrame, order: int) -> DataFrame:
    """(row, w, h2, h3, ...): each token and the 1, 2, ... tokens before it; a text begins with empty ones and ends with a line feed."""
    words = F.filter(F.split(F.translate("text", _UPPER, _UPPER.lower()), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    padded = docs.select("row", F.concat(F.array_repeat(F.lit(""), order - 1), words, F.array(F.lit("\n"))).alias("t"))
    before = lambda i, k: F.array_join(F.slice("t", i - (k - 1), k - 1), " ").alias(f"h{k}")
    each = F.transform(F.sequence(F.lit(order), F.size("t")), lambda i: F.struct(F.element_at("t", i).alias("w"), *(before(i, k) for k in range(2, order + 1))))
    return padded.select("row", F.inline(each))


@dataclass(frozen=True)
class Tables:
    """A model of any order in written tables: ngrams[k - 1] (h, w, p) and backoffs[k - 2] (h, alpha), h being k - 1 words."""

    order: int
    unknown: float  # the probability of an unknown word
    ngrams: list[DataFrame]
    backoffs: list[DataFrame]

    def save(self, path: str, buckets: int = 16) -> None:
        """Dealt by a hash of the history, one folder for each bucket."""
        bucket = F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")
        for name, frames in (("ngrams", self.ngrams), ("backoffs", self.backoffs)):
            for k, df in enumerate(frames):
                df.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}-{k}")
        self.ngrams[0].sparkSession.createDataFrame([(self.order, self.unknown)], "n int, unknown double").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> Tables:
        n, unknown = spark.read.parquet(f"{path}/meta").first()
        read = lambda name, many: [spark.read.parquet(f"{path}/{name}-{k}").drop("bucket") for k in range(many)]
        return Tables(n, unknown, read("ngrams", n), read("backoffs", n - 1))


def learn(docs: DataFrame, order: int = 3) -> Tables:
    """Tables of the texts' n-grams up to `order`, by the rules at the top of this module, in DataFrame functions.

    Null texts are empty (one token), repeated rows count each time; of an empty table every word is unknown. Only
    counts of counts reach the driver. score() does the same for bigrams, scores on the way and shuffles far less.
    """
    scratch = Scratch(docs.sparkSession, "katz-tables")
    tokens = scratch.put(_tokens(texts(docs, F.lit(0).alias("row")), order).drop("row"), "tokens")
    n, ngrams, backoffs = tokens.count(), [], []
    for k in range(1, order + 1):
        counts = scratch.put(tokens.groupBy((F.col(f"h{k}") if k > 1 else F.lit("")).alias("h"), "w").agg(F.count(F.lit(1)).alias("c")), f"counts-{k}")
        of = dict(counts.filter(F.col("c") <= SMALL + 1).groupBy("c").count().collect())
        d = discounts(np.array([of.get(r, 0) for r in range(1, SMALL + 2)]))
        mass = F.when(F.col("c") <= SMALL, F.element_at(F.array(*(F.lit(float(r * x)) for r, x in enumerate(d, 1))), F.least("c", F.lit(SMALL)).cast("int"))).otherwise(F.col("c") - TAIL)
        if k == 1:
            ngrams.append(scratch.put(counts.select("h", "w", (mass / max(1, n)).alias("p")), "ngrams-1"))
            unknown = 1 - (ngrams[0].agg(F.sum("p")).first()[0] or 0.0)
            continue
        totals = scratch.put(counts.groupBy("h").agg(F.sum("c").alias("total")), f"totals-{k}")
        here = scratch.put(counts.join(totals, "h").select("h", "w", (mass / F.col("total")).alias("p")), f"ngrams-{k}")
        shorter = F.expr("substring(h, locate(' ', h) + 1)") if k > 2 else F.lit("")
        both = here.withColumn("l", shorter).join(ngrams[-1].toDF("l", "w", "q"), ["l", "w"])
        left = both.groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        backoffs.append(scratch.put(left.select("h", ((1 - F.col("p")) / F.greatest(1 - F.col("q"), F.lit(1e-300))).alias("alpha")), f"backoffs-{k}"))
        ngrams.append(here)
    scratch.drop("tokens", *(f"counts-{k}" for k in range(1, order + 1)), *(f"totals-{k}" for k in range(2, order + 1)))
    return Tables(order, float(unknown), ngrams, backoffs)


def evaluate(docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, n_tokens, score) of each row: log10 of the text's probability, token by token from the longest history down.

    Documents may be others than those that the tables come from. Null texts are empty, repeated rows each have their
    score, an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "katz-scores")
    named = texts(docs, "doc_id").withColumn("row", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    at = _tokens(named.dropDuplicates(["row"]), tables.order).withColumn("so_far", F.lit(0.0))
    known = None
    for k in range(tables.order, 0, -1):
        met = at.withColumn("h", F.col(f"h{k}") if k > 1 else F.lit("")).join(tables.ngrams[k - 1], ["h", "w"], "left")
        met = scratch.put(met, f"order-{k}")
        # tokens with their answer leave; the others back off
        part = met.filter("p is not null").groupBy("row").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("so_far") + F.log10("p")).alias("score"))
        known = part if known is None else known.unionByName(part)
        at = met.filter("p is null").drop("p")
        if k > 1:
            at = at.join(tables.backoffs[k - 2], "h", "left").withColumn("so_far", F.col("so_far") + F.log10(F.coalesce("alpha", F.lit(1.0)))).drop("alpha")
        at = at.drop("h")
    unknown = F.lit(float(np.log10(tables.unknown)) if tables.unknown > 0 else float("-inf"))
    known = known.unionByName(at.groupBy("row").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("so_far") + unknown).alias("score")))
    scores = scratch.put(known.groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score")), "scores")
    scratch.drop_all_but("scores")
    return named.select("doc_id", "row").join(scores, "row").select("doc_id", "n_tokens", "score")


def op8_katz(spark, sf_dir: str) -> DataFrame:
    """held_out, token counts, base_score and score of each row of `documents`, see score."""
    return score(table(spark, sf_dir, "documents"))
