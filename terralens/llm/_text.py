"""Words, word hashes and shingles of many texts at once, as numpy arrays over Arrow's UTF-8 buffers.

A word is a run of bytes other than space, tab, LF, VT, FF and CR; A-Z fold to a-z where folding is asked for.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240611)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_CODE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
_FOLDED = _CODE.copy()
_FOLDED[65:91] = _CODE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_LANE = _rng.integers(1, 2**63, 16, dtype=U) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and each text's offsets into them."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about `most` bytes of text, one row at least."""
    _, at = buffers(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, starts_of: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the place of each text's first word (one more at the end).

    With starts_of, a row of hashes for whole words and one for their first k bytes for each k.
    """
    n = len(data)
    if n == 0:
        return np.zeros((1 + len(starts_of), 0) if starts_of else 0, U), np.zeros(len(offsets), np.int64)
    blank = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    before |= edge[:n]
    after = np.ones(n, bool)
    after[:-1] = blank[1:]
    after |= edge[1:]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    power, unpower = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((_FOLDED if fold else _CODE)[data] * power[:n], out=sums[1:])
    first = np.searchsorted(starts, offsets)
    if starts_of:
        tops = np.stack([ends, *(np.minimum(ends, starts + k) for k in starts_of)])
        return mix((sums[tops] - sums[starts]) * unpower[starts]), first
    return mix((sums[ends] - sums[starts]) * unpower[starts]), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and the place of each text's first one.

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(many, out=at[1:])
    out = np.zeros(int(at[-1]), U)
    if len(hashes) >= k:
        all_of = np.zeros(len(hashes) - k + 1, U)
        for j in range(k):
            all_of += hashes[j : len(hashes) - k + 1 + j] * _LANE[j]
        owner = np.repeat(np.arange(len(n)), many)
        long = (n >= k)[owner]
        place = first[:-1][owner] + np.arange(len(out)) - at[:-1][owner]
        out[long] = all_of[place[long]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        part = hashes[first[i] : first[i + 1]]
        with np.errstate(over="ignore"):
            out[at[i]] = (part * _LANE[: len(part)]).sum(dtype=U) + U(len(part)) * _LANE[15]
    return mix(out), at


def shingle_sets(batch: pa.RecordBatch, column: str = "text", k: int = 5) -> Iterator[np.ndarray]:
    """For each row its set of shingle hashes, sorted."""
    for piece in pieces(batch, column):
        values, at = shingles(*word_hashes(*buffers(piece.column(column))), k)
        for i in range(piece.num_rows):
            yield np.unique(values[at[i] : at[i + 1]])


def release() -> None:
    """Gives freed memory back to the system; Python workers live on after a task, side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(task: Callable, every: int = 4) -> Callable:
    """The task over Arrow batches, which releases memory after every few batches and at its end."""

    def run(batches):
        k = 0
        for k, out in enumerate(task(batches), 1):
            yield out
            if k % every == 0:
                release()
        release()

    return run


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes from each start to its end."""
    power, unpower = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_CODE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * unpower[starts])


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes stand between words."""
    return _SPACE[data]
