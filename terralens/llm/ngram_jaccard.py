"""Exact Jaccard self-join of documents' word-shingle sets, by partitioning the universe of shingles.

Sets fall into size bands of ratio 4/3, so that a set of at least 75 % similarity is in the same band or the next. For
each band the universe is cut into segments by hash. Two sets that differ in D shingles differ in D segments at most, and
D is at most H for partners of a band. Each set has H + 1 to give away among its segments: one to a segment of which it
indexes the whole subset (found if the segment is equal), two to one of which it indexes the subset and its one-deletion
neighbourhood (found if the segment differs by one shingle at most); by pigeonhole partners meet. Two allocations compete:

* whole subsets of the H + 1 cheapest of many small segments. Cost is the frequency of a subset's rarest shingle, from a
  bounded summary of all documents, so a passage that many documents share is seldom indexed. Every set of the band
  fills more segments than H, and as partners agree on all but H, the prefix argument makes them share an indexed one;
* neighbourhoods of H // 2 + 1 large segments.

Neighbourhoods index every shingle, about three times as much, so they compete in bands of small sets only: there both
allocations' entries and meeting pairs are counted over all documents (pairs by a sketch of second moments), and the
cheaper one is taken. In larger bands it is the first.

Documents that meet form stars: each is paired with the group's centre only, the member with the least share of rare
shingles. A pair whose parity bitmaps differ in more bits than the sets may differ in shingles cannot link and goes
without a look at its sets (one shingle changes one bit at most); the others are verified exactly. What stars miss are
links between two members x and y in different components. With X, Y their differences to the centre, x and y differ in
|X| + |Y| - 2 |X & Y| shingles: so X and Y must share elements, and these are joined the same way, by prefixes of X and Y in
one order, rare shingles first, keyed by centre and element. A pair at positions i and j of an element's list may link only
if 2i <= D - (|Y| - |X|) and 2j <= D + (|Y| - |X|), so of a group of unlinked near copies hardly any pair is left and no group is
compared all with all. Groups that are dense even so become stars of the next round, in which four times as many count
as dense. Equal sets are one node from the
start, so copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import _text
from terralens.llm._tables import Scratch, free, freed, table, texts
from terralens.llm.components import components

U = np.uint64
_SALT = U(0x632BE59BD9B4E019)
_MULTIPLES = (1, 2, 4, 16)
_SKETCH = 24
#: Sets up to this size are counted under both allocations; the sketch of their meeting pairs has so many counters.
_SMALL_SET = 19
_COUNTERS = 64
#: Pairs of entries that are looked at together.
_PAIRS = 1 << 20
#: Members with no more shingles than this are never sliced.
_TOGETHER = 20_000_000


def band_starts(longest: int) -> np.ndarray:
    """Least sizes of the bands; a set and a partner of 3/4 its size are at most one band apart."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, -(-4 * out[-1] // 3)))
    return np.array(out, np.int64)


def segments(s: np.ndarray, many: int) -> np.ndarray:
    """The segment of each shingle: equal slices of the hash range, so that sorted shingles have sorted segments."""
    return ((s >> U(32)) * U(many)) >> U(32)


class Plan:
    """What all tasks must agree on: the bands, their segments and allocations, and the cost of shingles. Its size has a bound."""

    def __init__(self, multiples: dict[int, int], cost: np.ndarray, parts: int, longest: int, nearby: frozenset[int] = frozenset()) -> None:
        self.starts = band_starts(longest + 1)
        self.multiples, self.parts = multiples, parts
        #: 1 + log2 of a frequent shingle's count in steps of a quarter, by the first bits of its hash; 0 for all others
        self.cost = cost
        self.nearby = nearby  # the bands that index neighbourhoods

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def upper(self, band: int) -> int:
        return int(self.starts[band + 1]) - 1

    def costs(self, s: np.ndarray) -> np.ndarray:
        return self.cost[s >> U(64 - _SKETCH)]

    def bands_of(self, n: int) -> list[tuple[int, int]]:
        """(band, H): a set's own band, and the one below if it has partners there."""
        band = self.band(n)
        out = [(band, (n + 4 * n // 3) // 7)]
        if band and -(-3 * n // 4) <= (u := self.upper(band - 1)):
            out.append((band - 1, (n + u) // 7))
        return out

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Hashes of what the set indexes."""
        return np.concatenate([self.neighbourhoods(s, band) if band in self.nearby else self.subsets(s, band, most) for band, most in self.bands_of(len(s))])

    def subsets(self, s: np.ndarray, band: int, most: int) -> np.ndarray:
        salt = U((band + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        seg = segments(s, min(1 << 32, self.multiples.get(band, 1) * self.upper(band)))
        begin = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
        subset = np.add.reduceat(s, begin) * _text._LANE[0] + (seg[begin] + U(1)) * _text._LANE[1] + salt
        if len(subset) > most + 1:
            price = np.minimum.reduceat(self.costs(s), begin)
            cheap = subset[price == 0]
            if len(cheap) > most + 1:
                subset = np.partition(cheap, most)[: most + 1]
            else:
                subset = subset[np.lexsort((subset, price))[: most + 1]]
        return _text.mix(subset)

    def neighbourhoods(self, s: np.ndarray, band: int) -> np.ndarray:
        """Of H // 2 + 1 segments the subset, empty ones too, and the subset without each one; of the last the subset only where H is even."""
        upper = self.upper(band)
        most = (upper + 4 * upper // 3) // 7
        many = most // 2 + 1
        seg = segments(s, many).astype(np.int64)
        salt = (np.arange(many, dtype=U) + U(1)) * _text._LANE[2] + U((band + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)
        mixed = _text.mix(s)
        sums = np.zeros(many, U)
        np.add.at(sums, seg, mixed)
        deeper = seg < many - 1 if most % 2 == 0 else np.ones(len(s), bool)
        return _text.mix(np.concatenate([sums + salt, (sums[seg] - mixed + salt[seg])[deeper]]))


def node_of(s: np.ndarray) -> int:
    """The name of a set: 63 bits of a hash of its members."""
    return int(_text.mix(np.array([_text.mix(s ^ _SALT).sum(dtype=U) + U(len(s))], U))[0] >> U(1))


def apart(n, m, percent: int):
    """The most shingles that linked sets of n and m shingles differ by."""
    return (100 - percent) * (n + m) // (100 + percent)


# --- passes over the documents ----------------------------------------------------------------------------------


class _Frequent:
    """Misra-Gries summary: every value with more than total / size occurrences stays in."""

    def __init__(self, size: int = 200_000) -> None:
        self.size, self.values, self.counts, self.held, self.n = size, np.zeros(0, U), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.n += len(values)
        if self.n > 1_000_000:
            self.merge()

    def merge(self) -> None:
        new, times = np.unique(np.concatenate([np.zeros(0, U), *self.held]), return_counts=True)
        self.held, self.n = [], 0
        often = times > 1
        values, at = np.unique(np.concatenate([self.values, new[often]]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, times[often]]), len(values)).astype(np.int64)
        if len(values) > self.size:
            counts -= np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
        self.values, self.counts = values[counts > 0], counts[counts > 0]


_SURVEY = "kind string, doc_id long, row long, n long, node long, bits binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ('doc', doc_id, row, size, node, bitmap) and ('small', ..., node, members) of small sets; at a task's end
    ('heavy', ..., count, shingle) and ('band', band, ..., value, what).

    what is -1 for the band's sets, -2 for the largest, or the place of a multiple: how many sets it leaves with too few
    filled segments.
    """
    frequent, starts = _Frequent(), band_starts(1 << 40)
    bands: dict[int, list[int]] = {}
    names = ["kind", "doc_id", "row", "n", "node", "bits"]

    def rows(kind: str, ids, row, n, node, bits=None) -> pa.RecordBatch:
        none = [None] * len(n)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), pa.array(ids or none, pa.int64()), row if isinstance(row, pa.Array) else pa.array(none, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits or none, pa.binary())], names)

    for b in batches:
        sizes, nodes, maps, small = [], [], [], []
        for s in _text.shingle_sets(b):
            n = len(s)
            sizes.append(n)
            nodes.append(node_of(s) if n else None)
            maps.append(parity(s).tobytes() if n else None)
            if not n:
                continue
            frequent.add(s)
            if n <= _SMALL_SET:
                small.append((n, nodes[-1], s.tobytes()))
            band = int(np.searchsorted(starts, n, "right")) - 1
            of = bands.setdefault(band, [0, 0, *[0] * len(_MULTIPLES)])
            of[0], of[1] = of[0] + 1, max(of[1], n)
            most, upper = (n + 4 * n // 3) // 7, int(starts[band + 1]) - 1
            for k, m in enumerate(_MULTIPLES):
                seg = segments(s, m * upper)
                if int((seg[1:] != seg[:-1]).sum()) >= most:  # one more segment than changes
                    break
                of[2 + k] += 1
        yield rows("doc", b.column("doc_id").to_pylist(), b.column("row"), sizes, nodes, maps)
        if small:
            yield rows("small", None, None, *map(list, zip(*small, strict=True)))
    frequent.merge()
    often = frequent.counts >= 2
    yield rows("heavy", None, None, frequent.counts[often], frequent.values[often].view(np.int64))
    for band, (count, longest, *unsafe) in bands.items():
        yield rows("band", [band] * (2 + len(_MULTIPLES)), None, [count, longest, *unsafe], [-1, -2, *range(len(_MULTIPLES))])


def _sketched(group: pa.Table) -> pa.Table:
    """The costs of the frequent shingles whose hashes have the same first eight bits."""
    at = (group.column("node").to_numpy().view(U) >> U(64 - _SKETCH)).astype(np.int64) & 0xFFFF
    out = np.zeros(1 << 16, np.uint8)
    np.maximum.at(out, at, np.minimum(255, 1 + 4 * np.log2(group.column("n").to_numpy())).astype(np.uint8))
    return pa.table({"slice": pa.array([group.column("slice")[0].as_py()], pa.int32()), "costs": pa.array([out.tobytes()], pa.binary())})


def _priced(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """(band, way, counter, value): for small bands and both allocations the entries (at counter -1) and a sketch of their second moment."""
    seen: set[int] = set()
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for node, members in zip(b.column("node").to_pylist(), b.column("bits").to_pylist(), strict=True):
            if node in seen:
                continue
            seen.add(node)
            s = np.frombuffer(members, U)
            for band, most in plan.bands_of(len(s)):
                if plan.upper(band) <= _SMALL_SET:
                    for way, sigs in enumerate((plan.subsets(s, band, most), plan.neighbourhoods(s, band))):
                        of = sums.setdefault((band, way), np.zeros(1 + _COUNTERS, np.int64))
                        h = _text.mix(sigs)
                        of[0] += len(sigs)
                        np.add.at(of, 1 + (h % U(_COUNTERS)).astype(np.int64), np.where(h >> U(63), 1, -1))
    rows = [(band, way, k - 1, v) for (band, way), of in sums.items() for k, v in enumerate(of.tolist()) if v]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["band", "way", "counter", "value"])


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 4 bits a shingle, each the parity of the shingles that fall on it."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def differ(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter's length."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sets_rows(batches: Iterator[pa.RecordBatch], short: bool = False) -> Iterator[pa.RecordBatch]:
    """(node, members): the set of each node, once a task; short members have six bytes."""
    seen: set[int] = set()
    for b in batches:
        nodes, members = [], []
        for s in _text.shingle_sets(b):
            if len(s) and (node := node_of(s)) not in seen:
                seen.add(node)
                nodes.append(node)
                members.append(six_bytes(s) if short else s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(members, pa.binary())], ["node", "members"])


# --- entries, packed by part ------------------------------------------------------------------------------------

_SENT = "part int, kind int, docs binary, keys binary, places binary, spots binary"
_ENTRIES, _LEADS, _INNER = 0, 1, 2
#: pref: the least of a group is its centre. Of signatures the share of rare shingles, of differences their number.
_SIGNED = np.dtype([("node", "<i8"), ("pref", "u1")])
#: index, probe: how many of its differences a document indexes and probes with.
_CHANGED = np.dtype([("node", "<i8"), ("pref", "<i4"), ("comp", "<i8"), ("n", "<i4"), ("index", "<i4"), ("probe", "<i4")])
#: Differences go by 48 bits of shingles' hashes. Where two of a pair agree by chance they seem two fewer, so bounds are wider.
_SLACK = 2


def _narrow(x: np.ndarray, most: int) -> bytes:
    return x.astype("<u2" if most < 1 << 16 else "<u4").tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    """n numbers that _narrow has packed."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def six_bytes(s: np.ndarray) -> bytes:
    """The first 48 bits of sorted hashes."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.unique(out.view("<u8").ravel())


class _Outbox:
    """Entries of some documents, packed by part: one row for each part instead of one for each entry.

    Where more than `hot` documents here share a key, only the centre goes on to the key's part, marked as a lead; the
    others follow as (lead, key, member), spread over all parts, so no key sends more than `hot` entries of a batch to one.
    """

    def __init__(self, parts: int, kind: np.dtype, hot: int) -> None:
        self.parts, self.kind, self.hot = parts, kind, hot
        self.docs, self.keys, self.n = [], [], 0

    def add(self, doc: tuple, keys: np.ndarray) -> None:
        self.docs.append(doc)
        self.keys.append(keys)
        self.n += len(keys)

    def flush(self) -> pa.RecordBatch:
        docs = np.array(self.docs, self.kind)
        place = np.repeat(np.arange(len(docs), dtype=np.int32), [len(x) for x in self.keys])
        keys = np.concatenate([np.zeros(0, U), *self.keys])
        # differences have places in their document's list
        spots = None if self.kind is _SIGNED else np.concatenate([np.zeros(0, np.int64), *map(np.arange, map(len, self.keys))])
        self.docs, self.keys, self.n = [], [], 0
        order = np.argsort(keys)
        keys, place = keys[order], place[order]
        spots = spots if spots is None else spots[order]
        rows = []
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        many = np.diff(np.append(begin, len(keys)))
        if (many > self.hot).any():
            hot = np.flatnonzero(np.repeat(many > self.hot, many))
            k, d = keys[hot], docs[place[hot]]
            order = np.lexsort((d["node"], d["pref"], k))
            k, d = k[order], d[order]
            first = np.append(True, k[1:] != k[:-1])
            lead = np.repeat(d["node"][first], np.diff(np.append(np.flatnonzero(first), len(k))))
            inner = np.flatnonzero(~first)
            for i in range(0, len(inner), 1 << 16):
                some = inner[i : i + (1 << 16)]
                rows.append((int(lead[some[0]] + i // (1 << 16)) % self.parts, _INNER, lead[some].tobytes(), k[some].tobytes(), d["node"][some].tobytes(), b""))
            rows += self._packed(_LEADS, docs, k[first], place[hot[order[first]]], None)
            stay = np.ones(len(keys), bool)
            stay[hot] = False
            keys, place = keys[stay], place[stay]
            spots = spots if spots is None else spots[stay]
        rows += self._packed(_ENTRIES, docs, keys, place, spots)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "kind", "docs", "keys", "places", "spots"])

    def _packed(self, kind: int, docs: np.ndarray, keys: np.ndarray, place: np.ndarray, spots: np.ndarray | None) -> Iterator[tuple]:
        # parts are slices of the keys' range, so each is one run
        at = np.searchsorted((keys >> U(32)) * U(self.parts) >> U(32), np.arange(self.parts + 1, dtype=U))
        for part in np.flatnonzero(np.diff(at)).tolist():
            run = slice(at[part], at[part + 1])
            used, where = np.unique(place[run], return_inverse=True)
            yield part, kind, docs[used].tobytes(), keys[run].tobytes(), _narrow(where, len(used)), b"" if spots is None else _narrow(spots[run], int(spots[run].max()))


_FOUND = "kind int, a long, b long, key long"
#: a pair; (centre, lead, key); (lead, member, key); a centre and a member of a group of three or more
_PAIR, _HEAD, _MEMBER, _STAR = 0, 1, 2, 3


def _unpacked(group: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents, spots and whether they are leads, sorted by key and centre first; and rows (lead, member, key)."""
    keys, docs, spots, leads, inner = [np.zeros(0, U)], [np.zeros(0, kind)], [np.zeros(0, "<u4")], [np.zeros(0, bool)], [np.zeros((0, 3), np.int64)]
    for k, d, key, place, spot in zip(*(group.column(c) for c in ("kind", "docs", "keys", "places", "spots")), strict=True):
        k, d, key, place, spot = k.as_py(), d.as_py(), np.frombuffer(key.as_py(), U), place.as_py(), spot.as_py()
        if k == _INNER:
            inner.append(np.stack([np.frombuffer(d, np.int64), np.frombuffer(place, np.int64), key.view(np.int64)], 1))
            continue
        d = np.frombuffer(d, kind)
        keys.append(key)
        docs.append(d[_widened(place, len(key))])
        spots.append(_widened(spot, len(key)) if spot else np.zeros(len(key), "<u4"))
        leads.append(np.full(len(key), k == _LEADS))
    keys, docs, spots, leads = (np.concatenate(x) for x in (keys, docs, spots, leads))
    # alone in a group means nothing, but for a lead
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    order = order[(np.append(False, same) | np.append(same, False))[: len(order)] | leads[order]]
    order = order[np.lexsort((docs["node"][order], docs["pref"][order], keys[order]))]
    return keys[order], docs[order], spots[order].astype(np.int64), leads[order], np.concatenate(inner)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))] if len(pairs) else pairs


def _starred(keys: np.ndarray, nodes: np.ndarray, leads: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Stars of sorted groups, as arrays (a, b, key) by kind."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    many = np.diff(np.append(begin, len(keys)))
    centre, wide = np.repeat(nodes[begin], many), np.repeat((many > 2) | (np.add.reduceat(leads, begin) > 0 if len(begin) else False), many)
    both = np.stack([centre, nodes, keys.view(np.int64)], 1)
    other = (centre != nodes) & ~leads
    zero = np.zeros(1, np.int64)
    flat = lambda rows: np.concatenate([d := _distinct(rows[:, :2]), np.repeat(zero, len(d))[:, None]], 1)
    return [(_PAIR, flat(both[other & ~wide])), (_STAR, flat(both[other & wide])), (_HEAD, both[leads])]


def matched(keys: np.ndarray, docs: np.ndarray, spots: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (a, b) of sorted groups of differences that may link, by their places in both lists; see the module.

    An entry meets those after it in its group that probe with the element and have few enough more differences: a run, as
    groups stand in the order of differences. Runs are compared a few million pairs at a time, cut inside a group and inside
    a run too, so memory does not depend on a group's size.
    """
    out = [np.zeros((0, 2), np.int64)]
    n, pref = docs["n"].astype(np.int64), docs["pref"].astype(np.int64)
    group = np.cumsum(np.append(True, keys[1:] != keys[:-1])[: len(keys)]) - 1
    left, right = np.flatnonzero(spots < docs["index"]), np.flatnonzero(spots < docs["probe"])
    # one order over all groups: the group, then the differences
    wide = int(pref.max(initial=0)) + 1
    most = np.minimum(apart(n[left], 100 * n[left] // percent, percent) + _SLACK, wide)
    place = group[right] * (2 * wide) + pref[right]
    begin = np.searchsorted(right, left, "right")
    many = np.maximum(np.searchsorted(place, group[left] * (2 * wide) + pref[left] + most, "right") - begin, 0)
    ends = np.cumsum(many)
    for at in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
        pair = np.arange(at, min(at + _PAIRS, int(ends[-1])))
        run = np.searchsorted(ends, pair, "right")
        a, b = left[run], right[begin[run] + pair - (ends[run] - many[run])]
        ok = docs["comp"][a] != docs["comp"][b]
        a, b = a[ok], b[ok]
        gap, far = pref[b] - pref[a], apart(n[a], n[b], percent) + _SLACK
        ok = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (gap <= far) & (2 * spots[a] <= far - gap) & (2 * spots[b] <= far + gap)
        out.append(_distinct(np.stack([docs["node"][a[ok]], docs["node"][b[ok]]], 1)))
    return _distinct(np.concatenate(out))


def _met(group: pa.Table, percent: int | None, dense_from: int = 0) -> pa.Table:
    """What a part's groups make: with a percentage pairs of differences, and stars of groups above `dense_from` members; without, stars of all."""
    keys, docs, spots, leads, inner = _unpacked(group, _SIGNED if percent is None else _CHANGED)
    found = [(_MEMBER, inner)]
    if percent is None:
        found += _starred(keys, docs["node"], leads)
    else:
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        many = np.diff(np.append(begin, len(keys)))
        dense = np.repeat((many > dense_from) | (np.add.reduceat(leads, begin) > 0 if len(begin) else False), many)
        found += _starred(keys[dense], docs["node"][dense], leads[dense])
        pairs = matched(keys[~dense], docs[~dense], spots[~dense], percent)
        found.append((_PAIR, np.concatenate([pairs, np.zeros((len(pairs), 1), np.int64)], 1)))
    rows = np.concatenate([x for _, x in found])
    kinds = np.concatenate([np.full(len(x), k, np.int32) for k, x in found])
    del keys, docs, found
    _text.release()
    return pa.table({"kind": pa.array(kinds), **{c: pa.array(np.ascontiguousarray(rows[:, i])) for i, c in enumerate(("a", "b", "key"))}})


# --- pairs ------------------------------------------------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def changes(centre: np.ndarray, s: np.ndarray, centre_cost: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The differences of a set to the centre in the order of all members' lists: added shingles, rare ones first, then missing ones, frequent ones first."""
    added = ~np.isin(s, centre, assume_unique=True)
    missing = ~np.isin(centre, s, assume_unique=True)
    a, m = s[added], centre[missing]
    return np.concatenate([a[np.lexsort((a, cost[added]))], m[np.lexsort((m, -centre_cost[missing].astype(np.int16)))]])


def prefixes(n: int, differences: int, centre: int, outside: bool, percent: int) -> tuple[int, int]:
    """How many of a member's differences it indexes, for partners with more of them, and with how many it probes, for those with fewer.

    A member of the centre's component has partners outside only, which differ from the centre by more than linked sets do.
    """
    most = apart(n, 100 * n // percent, percent) + _SLACK
    index = min(differences, most // 2 + 1)
    if not outside:
        index = min(index, 4 * differences // 7 + 1 + _SLACK)
    probes = outside or differences + _SLACK > apart(percent * n // 100, centre, percent)
    return index, min(differences, most + 1) if probes else 0


class _Join:
    """The steps of one run, which share its base table, survey and scratch folder."""

    def __init__(self, base: DataFrame, percent: int, heavy_least: int, broadcast_nodes: int, hot: int = 64, dense: int = 2048, together: float = 0.5) -> None:
        self.spark, self.base, self.percent, self.few = base.sparkSession, base, percent, broadcast_nodes
        #: entries of one key that a batch may send; members from which a group of differences is a star of the next round
        self.hot, self.dense = hot, dense
        #: the share of all documents' shingles that members whose differences are looked at together have at most
        self.together = together
        self.scratch = Scratch(self.spark, "jaccard")
        self.tasks = 4 * self.spark.sparkContext.defaultParallelism  # enough of them to keep all cores busy
        self.survey = self.scratch.put(base.mapInArrow(_text.tidied(_survey), _SURVEY), "survey", "kind")
        self.info = self.survey.filter("kind = 'doc'").select("doc_id", "row", "n", "node")
        self.plan = self.spark.sparkContext.broadcast(self._planned(heavy_least))
        self.step = 0

    def _planned(self, heavy_least: int) -> Plan:
        heavy = self.survey.filter("kind = 'heavy'").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= heavy_least)
        slices = heavy.withColumn("slice", F.shiftrightunsigned("node", 56).cast("int")).groupBy("slice").applyInArrow(_sketched, "slice int, costs binary")
        cost = np.zeros(1 << _SKETCH, np.uint8)  # the result has 256 rows of 64 KiB at most
        for r in slices.collect():
            cost[r["slice"] << 16 : (r["slice"] + 1) << 16] = np.frombuffer(r["costs"], np.uint8)
        total, longest = self.info.agg(F.sum("n"), F.max("n")).first()
        starts = band_starts((longest or 1) + 1)
        unsafe = self.survey.filter("kind = 'band'").groupBy("doc_id", "node").agg(F.sum("n").alias("n")).collect()
        multiples: dict[int, int] = {}
        for band in range(len(starts) - 1):
            bad = {r["node"]: r["n"] for r in unsafe if r["doc_id"] == band}
            # sets of the next band index this one too; they fill more segments, for they are larger
            ok = [m for k, m in enumerate(_MULTIPLES) if not bad.get(k)]
            multiples[band] = ok[0] if ok else 1 << 32  # nearly every shingle a segment of its own
        parts = max(self.tasks, -(-int((total or 0) * 0.7) // 4_000_000))  # bounded memory in each
        self.most_together = max(_TOGETHER, int((total or 0) * self.together))
        plan = Plan(multiples, cost, parts, longest or 1)
        plan.nearby = self._nearby(plan)
        _text.release()
        return plan

    def _nearby(self, plan: Plan) -> frozenset[int]:
        """The bands in which neighbourhoods cost less than whole subsets, by entries and meeting pairs over all documents."""
        shared = self.spark.sparkContext.broadcast(plan)
        small = self.survey.filter("kind = 'small'").select("node", "bits")
        counted = small.mapInArrow(lambda it: _priced(it, shared.value), "band long, way long, counter long, value long")
        cost: dict[tuple[int, int], float] = {}
        for r in counted.groupBy("band", "way", "counter").agg(F.sum("value").alias("value")).collect():
            at = r["band"], r["way"]
            # entries, and half of the second moment beyond them
            cost[at] = cost.get(at, 0.0) + (0.5 * r["value"] if r["counter"] < 0 else 0.5 * float(r["value"]) ** 2)
        shared.destroy()
        return frozenset(band for band, way in cost if way == 1 and cost[band, 1] < cost.get((band, 0), float("inf")))

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        return self.scratch.put(df, f"{name}-{self.step}", *by)

    def done(self, *names: str) -> None:
        """Deletes tables of this step."""
        self.scratch.drop(*(f"{name}-{self.step}" for name in names))

    def signed(self) -> DataFrame:
        """What documents that share a signature make, see _FOUND."""
        plan, hot = self.plan, self.hot

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            box, seen = _Outbox(plan.value.parts, _SIGNED, hot), set()
            for b in batches:
                for s in _text.shingle_sets(b):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        box.add((node, int(255 * (plan.value.costs(s) == 0).mean())), np.unique(plan.value.signatures(s)))
                    if box.n > 400_000:
                        yield box.flush()
                        seen.clear()
            yield box.flush()

        sent = self.base.select("text").mapInArrow(_text.tidied(send), _SENT)
        return sent.groupBy("part").applyInArrow(lambda g: _met(g, None), _FOUND)

    def pairs(self, made: DataFrame | Iterable[DataFrame]) -> DataFrame:
        """(a, b, wide): distinct pairs; wide ones are a centre and a member of a group of three or more.

        What is made is written one after the other, so one's shuffles are gone before the next begins.
        """
        names, found = [], None
        for k, some in enumerate([made] if isinstance(made, DataFrame) else made):
            names.append(f"found-{k}")
            some = self.put(some, names[-1], "kind").select("kind", "a", "b", "key")
            found = some if found is None else found.unionByName(some)
            freed(self.spark)
        of = lambda kind: found.filter(F.col("kind") == kind)
        both = of(_PAIR).select("a", "b", F.lit(False).alias("wide")).unionByName(of(_STAR).select("a", "b", F.lit(True).alias("wide")))
        if not of(_HEAD).isEmpty():
            heads = of(_HEAD).select(F.col("a").alias("centre"), F.col("b").alias("lead"), "key")
            members = of(_MEMBER).select(F.col("a").alias("lead"), "b", "key").join(heads, ["lead", "key"]).select(F.col("centre").alias("a"), "b")
            more = members.unionByName(heads.select(F.col("centre").alias("a"), F.col("lead").alias("b"))).filter("a <> b")
            both = both.unionByName(more.withColumn("wide", F.lit(True)))
        out = self.put(both.groupBy("a", "b").agg(F.max("wide").alias("wide")), "pairs")
        self.done(*names)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b): the pairs that link exactly."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = self.survey.filter("kind = 'doc' and n > 0").select("node", "n", "bits")
        self.maps = maps = self.put(own.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "maps")
        close = self.put(self._close(pairs, maps), "close")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [similar(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), percent) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        sets = self.put(self.sets(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "close"), "sets")
        if sets.count() > self.wanted:  # rows that repeat
            sets = self.put(sets.groupBy("node").agg(F.first("members").alias("members")), "sets-once")
        both = close.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
        out = self.put(both.mapInArrow(_text.tidied(run), "a long, b long"), "links")
        self.done("close", "close-nodes", "sets", "sets-once")
        return out

    def _close(self, pairs: DataFrame, maps: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and bitmaps admit a link; maps (node, n, bits).

        Joins are on the node; one with very many partners is split by adaptive execution.
        """
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
                ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                for i in np.flatnonzero(ok):
                    ok[i] = differ(np.frombuffer(b.column("x")[i].as_py(), U), np.frombuffer(b.column("y")[i].as_py(), U)) <= apart(int(n[i]), int(m[i]), percent)
                yield b.select(["a", "b"]).filter(pa.array(ok))

        met = pairs.select("a", "b").join(maps.toDF("b", "m", "y"), "b").join(maps.toDF("a", "n", "x"), "a").select("a", "b", "n", "m", "x", "y")
        return met.mapInArrow(_text.tidied(run), "a long, b long")

    def sets(self, nodes: DataFrame, name: str, short: bool = False) -> DataFrame:
        """(node, members) of distinct nodes, more than once where a row repeats. Whole texts are read again for their documents only: one of each node."""
        nodes = self.put(nodes, f"{name}-nodes")
        self.wanted = nodes.count()
        sized = F.broadcast if self.wanted <= self.few else (lambda df: df)
        chosen = self.info.join(sized(nodes), "node").groupBy("node").agg(F.min("row").alias("row")).select("row")
        picked = self.base.join(sized(chosen), "row", "left_semi").select("text")
        return picked.mapInArrow(_text.tidied(lambda it: _sets_rows(it, short)), "node long, members binary").join(sized(nodes), "node", "left_semi")

    def mixed(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """(c, node, own, other, size): members of the stars that have members outside the centre's component, two members at least."""
        named = pairs.filter("wide").join(labels.toDF("b", "other"), "b", "left").join(labels.toDF("a", "own"), "a", "left")
        named = named.select(F.col("a").alias("c"), F.col("b").alias("node"), F.coalesce("own", "a").alias("own"), F.coalesce("other", "b").alias("other"))
        stars = named.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("own") != F.col("other")).alias("out")).filter("out and size > 1")
        return self.put(named.join(stars.select("c", "size"), "c"), "mixed")

    def changed(self, mixed: DataFrame) -> Iterator[DataFrame]:
        """What members of a star that share differences to its centre make, see _FOUND.

        Members and their sets grow faster than the documents, as more of these share a passage. Stars are dealt to so many
        slices that the sets of one, which are shuffled, stay a share of the input.
        """
        size = mixed.join(self.maps.select("node", "n"), "node").agg(F.sum("n")).first()[0]
        slices = max(1, -(-int(size or 0) // self.most_together))
        for k in range(slices):
            yield self._changed(mixed.filter(F.pmod(F.xxhash64("c"), F.lit(slices)) == k) if slices > 1 else mixed, f"mixed-{k}")

    def _changed(self, mixed: DataFrame, name: str, chunk: int = 256) -> DataFrame:
        """changed, of some stars. A star's members are dealt in chunks, each with the centre's set, so no star meets in one task."""
        nodes = mixed.select(F.explode(F.array("c", "node")).alias("node")).distinct()
        sets = self.sets(nodes, name, short=True)
        chunks = F.ceil(F.col("size") / chunk).cast("int")
        stars = mixed.groupBy("c").agg(F.first("own").alias("own"), F.first("size").alias("size"))
        centres = stars.select("c", F.col("c").alias("node"), "own", F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        dealt = mixed.select("c", "node", "own", "other", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk")).unionByName(centres)
        size, members = mixed.join(self.maps.select("node", "n"), "node").agg(F.sum("n"), F.count(F.lit(1))).first()
        sized = F.broadcast if members <= self.few else (lambda df: df)
        cells, parts, percent, plan = max(self.tasks, int(size or 0) // 2_000_000), max(self.tasks, int(size or 0) // 6_000_000), self.percent, self.plan
        # A star's group is a smaller star, without its centre, so rounds come to an end; late ones compare larger groups.
        hot, dense = self.hot << 2 * self.step, self.dense << max(0, self.step - 6)

        def differences(group: pa.Table) -> pa.Table:
            box, out = _Outbox(parts, _CHANGED, hot), []
            c, chunk, node = (group.column(x).to_numpy() for x in ("c", "chunk", "node"))
            order = np.lexsort((node, node != c, chunk, c))
            last = centre = centre_cost = None
            salt = U(0)
            for i in order.tolist():
                c, node, own, other, chunk = (group.column(x)[i].as_py() for x in ("c", "node", "own", "other", "chunk"))
                if (c, chunk, node) == last:  # a row that repeats
                    continue
                last = c, chunk, node
                s = from_six_bytes(group.column("members")[i].as_py())
                if node == c:
                    centre, centre_cost, salt = s, plan.value.costs(s), _text.mix(np.array([c], np.int64).view(U))[0]
                    continue
                of = changes(centre, s, centre_cost, plan.value.costs(s))
                index, probe = prefixes(len(s), len(of), len(centre), own != other, percent)
                box.add((node, len(of), other, len(s), index, probe), _text.mix(of[: max(index, probe)] ^ salt))
                if box.n > 400_000:
                    out.append(box.flush())
            out.append(box.flush())
            _text.release()
            return pa.Table.from_batches(out)

        cell = F.pmod(F.xxhash64("c", "chunk"), F.lit(cells)).cast("int")
        sent = sets.join(sized(dealt), "node").withColumn("cell", cell).groupBy("cell").applyInArrow(differences, _SENT)
        return sent.groupBy("part").applyInArrow(lambda g: _met(g, percent, dense), _FOUND)

    def labels(self) -> DataFrame:
        """(node, component) of all linked nodes."""
        pairs = self.pairs(self.signed())
        links = self.links(pairs)
        labels = components(links, self.scratch)
        while True:
            mixed = self.mixed(pairs, labels)
            if mixed.isEmpty():
                return labels
            self.step += 1
            pairs = self.pairs(self.changed(mixed))
            more = self.links(pairs)
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = components(links, self.scratch)

    def placed(self) -> DataFrame:
        """(doc_id, row, n, component) of each row, the component null for empty sets."""
        labels = self.labels()
        out = self.info.join(labels, "node", "left").select("doc_id", "row", "n", F.coalesce("component", "node").alias("component"))
        out = self.scratch.put(out, "placed")
        self.scratch.drop_all_but("placed")
        self.plan.destroy()
        freed(self.spark)
        return out


# --- the operator -----------------------------------------------------------------------------------------------


def _placed(docs: DataFrame, row: list[str], percent: int, heavy_least: int, broadcast_nodes: int, **bounds: int) -> DataFrame:
    if percent < 75:
        raise ValueError("the bands hold for 75 percent and more")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(*row).alias("row"))
    return _Join(texts(named, "doc_id", "row"), percent, heavy_least, broadcast_nodes, **bounds).placed()


def classes(docs: DataFrame, percent: int = 75, heavy_least: int = 3, broadcast_nodes: int = 1_000_000, **bounds: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: near-duplicate classes of the documents.

    Words are runs without space, tab, LF, VT, FF or CR, A-Z folded; a document's set holds its 5-word shingles, or with
    fewer words its whole sequence. Two documents link when 100 * shared >= percent * all of their shingles (percent is
    75 at least); component_id is the least doc_id reachable by links. Null and blank texts have an empty set and link
    with nothing; repeated rows are copies; a null doc_id is never a component_id unless it is alone; an empty table
    gives none; other columns are ignored. Sets go by 64-bit hashes of their shingles. Counts cover all documents; only
    the bounded plan (bands, allocations, 16 MiB of costs) reaches the driver. Sets of candidates are picked by a
    broadcast list of up to `broadcast_nodes` nodes (counted first), beyond that by a shuffle. `bounds` are the sizes of
    groups, `hot` and `dense`, from which another way is taken to the same result, and `together`, what is compared at a time.
    """
    placed = _placed(docs, ["doc_id", "text"], percent, heavy_least, broadcast_nodes, **bounds)
    least = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # written, so that the join has exchanges of its own, in which a large class is split
    least = Scratch(docs.sparkSession, "least").put(least, "ids")
    return placed.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, percent: int = 75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of each near-duplicate class, with all columns; rows are told apart by all of their columns, not by doc_id.

    The row with the least doc_id stays, null ones last, and of several the one with the least hash of its columns. Rows
    with an empty set are copies of nothing and stay, repeated ones too. Of rows that are equal in all columns one stays.
    An empty table gives none.
    """
    placed = _placed(docs, docs.columns, percent, 3, broadcast_rows)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    scratch = Scratch(docs.sparkSession, "kept")
    least = scratch.put(placed.filter("component is not null").groupBy("component").agg(F.min(place).alias("least")), "least")
    extra = placed.join(least, "component").filter(F.col("row") != F.col("least.row")).select("row").distinct()
    (name,) = free(docs.columns, "__row")
    extra = scratch.put(extra.select(F.col("row").alias(name)), "extra")
    sized = F.broadcast if extra.count() <= broadcast_rows else (lambda df: df)
    kept = docs.withColumn(name, F.xxhash64(*docs.columns)).join(sized(extra), name, "left_anti")
    twice = scratch.put(placed.filter("component is not null").groupBy(F.col("row").alias(name)).count().filter("count > 1").select(name).join(extra, name, "left_anti"), "twice")
    if not twice.isEmpty():
        again = F.broadcast if twice.count() <= broadcast_rows else (lambda df: df)
        kept = kept.join(again(twice), name, "left_anti").unionByName(kept.join(again(twice), name, "left_semi").dropDuplicates([name]))
    return kept.select(*docs.columns)


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `documents`, see classes."""
    return classes(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM texts),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * c >= 75 * (m.n + n.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM texts UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM texts t JOIN least ON x = t.doc_id LEFT JOIN sizes s ON s.doc_id = t.doc_id"""
