"""A Merkle manifest of a table: one tree for each language over its rows by id, and one over the languages' roots.

H is the lowercase hex SHA-256 of its inputs, one behind the other. `fanout` consecutive nodes of a level (fewer in its last
run, even one) become their H, until one is left; nothing is padded.

Rows are sorted by ranges and every row gets its index in its tree, so a partition holds runs of consecutive leaves that
begin and end anywhere. Each run climbs on its own with a mountain range: one pending group of siblings a level, which is
carried to the level above when its last sibling comes. What is complete is written as a node record; what waits for
siblings outside the run (the peaks on its right, the unaligned edge on its left) is left open. Open nodes of many runs,
a few for each level and run, climb again together in order until none is left.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.llm import _text
from terralens.llm._sql import crc32
from terralens.llm._tables import Scratch, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, size long, level int, index long, digest string, open boolean"
#: Rows that one task, or a broadcast, may get whole: about 10 MB of digests.
_FEW = 100_000


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sizes(n: int, fanout: int) -> list[int]:
    """The number of nodes on each level of a tree of n leaves, the last one 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """The mountain range of one run of a tree: for each level the siblings that wait for the rest of their group."""

    def __init__(self, tree: str, n: int, fanout: int) -> None:
        self.tree, self.n, self.fanout, self.sizes = tree, n, fanout, sizes(n, fanout)
        self.waiting: list[dict[int, str]] = [{} for _ in self.sizes]
        self.done: list[tuple] = []

    def add(self, level: int, index: int, digest: str) -> None:
        """A node whose group is complete with it becomes its parent, and so on upwards."""
        while True:
            if self.sizes[level] == 1:
                self.done.append((level, index, digest, False))
                return
            parent, group = index // self.fanout, self.waiting[level]
            if group and next(iter(group)) // self.fanout != parent:
                self._leave(level)
                group = self.waiting[level]
            group[index] = digest
            if len(group) < min(self.fanout, self.sizes[level] - parent * self.fanout):
                return
            inside = sorted(group.items())
            self.waiting[level] = {}
            if level:
                self.done += [(level, i, d, False) for i, d in inside]
            level, index, digest = level + 1, parent, H(*(d for _, d in inside))

    def _leave(self, level: int) -> None:
        self.done += [(level, i, d, True) for i, d in self.waiting[level].items()]
        self.waiting[level] = {}

    def close(self) -> None:
        for level in range(len(self.waiting)):
            self._leave(level)


def _climb(fanout: int):
    """The task that turns (tree, size, level, index, digest) in order into node records and open nodes."""

    def rows(done: list[tuple], now: Range) -> pa.RecordBatch:
        level, index, digest, is_open = zip(*done, strict=True)
        n = len(done)
        out = [pa.array([now.tree] * n, pa.string()), pa.array([now.n] * n, pa.int64()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(digest), pa.array(is_open)]
        return pa.RecordBatch.from_arrays(out, ["tree", "size", "level", "index", "digest", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Range | None = None
        for b in batches:
            for tree, n, level, index, digest in zip(*(b.column(c).to_pylist() for c in ("tree", "size", "level", "index", "digest")), strict=True):
                if now is None or now.tree != tree:
                    if now:
                        now.close()
                        if now.done:
                            yield rows(now.done, now)
                    now = Range(tree, n, fanout)
                now.add(level, index, digest)
            if now and now.done:
                yield rows(now.done, now)
                now.done = []
        if now:
            now.close()
            if now.done:
                yield rows(now.done, now)

    return _text.tidied(run)


@dataclass(frozen=True)
class Forest:
    """leaves: their columns with tree, size and index; nodes: (tree, size, level, index, digest) of all levels above the leaves; roots: (tree, size, digest)."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    fanout: int


def grow(rows: DataFrame, order: list[Column], fanout: int, scratch: Scratch, name: str, few_trees: bool = False) -> Forest:
    """The trees of rows that have a tree (a string, not null) and a digest; `order` sorts the leaves of a tree.

    Rows that are equal in order and digest may stand in any order; they may be most of the table, so ranges are cut
    inside them too. A tree may hold most rows: its ranges are of bounded size like all others. few_trees: the rows were
    counted before (they are another forest's roots), so counting is cheap, and if they are few one range will do.
    """
    sort = [F.col("tree"), *order, F.col("digest")]
    if few_trees and rows.count() <= _FEW:
        ranged = rows.coalesce(1).sortWithinPartitions(*sort)
    else:
        ranged = rows.withColumn("__spread", F.monotonically_increasing_id()).repartitionByRange(*sort, "__spread").sortWithinPartitions(*sort).drop("__spread")
    placed = scratch.put(ranged.withColumn("__place", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftright("__place", 33)
    found = placed.groupBy(part.alias("__part"), "tree").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first"))
    found = scratch.put(found, f"{name}-spans")  # about one a range and tree
    few = found.count() <= _FEW
    found = found.coalesce(1) if few else found
    ahead = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("__part", "tree", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    indexed = placed.withColumn("__part", part).join(F.broadcast(spans) if few else spans, ["__part", "tree"])
    indexed = indexed.withColumn("index", F.col("__place") - F.col("first") + F.col("before")).drop("first", "before")
    leaves = scratch.put(indexed.sortWithinPartitions("__part", "__place").drop("__part", "__place"), f"{name}-leaves")
    scratch.drop(f"{name}-placed")

    level_rows = leaves.select("tree", "size", F.lit(0).alias("level"), "index", "digest")
    written = []
    start = F.col("index") * F.pow(F.lit(float(fanout)), F.col("level")).cast("long")
    for step in itertools.count():
        climbed = scratch.put(level_rows.mapInArrow(_climb(fanout), _NODE), f"{name}-climb-{step}")
        written.append(climbed.filter("not open").drop("open"))
        peaks = climbed.filter("open").drop("open")
        # an open node stays a node: it gets its record when its group is complete
        waiting, most = peaks.count(), max(_FEW, 4096 * fanout)
        if not waiting:
            break
        dealt = peaks.repartitionByRange(-(-waiting // most), "tree", start) if waiting > most else peaks.coalesce(1)
        level_rows = dealt.sortWithinPartitions("tree", start, "level")
    nodes = written[0]
    for w in written[1:]:
        nodes = nodes.unionByName(w)
    # the only node that no level above covers
    tops = nodes.filter(F.pow(F.lit(float(fanout)), F.col("level")) >= F.col("size")).select("tree", "size", "digest")
    return Forest(leaves, nodes, scratch.put(tops, f"{name}-roots"), fanout)


def _path(index: int, level: int, digests: dict[int, list[str]], first: dict[int, int], heights: list[int], fanout: int, stop: int) -> list[tuple[int, str]]:
    """(place among its siblings, the others' digests) of a node and of its ancestors below level `stop`."""
    out = []
    while level < stop:
        begin = index // fanout * fanout
        end, at = min(begin + fanout, heights[level]), digests[level]
        others = "".join(at[j - first[level]] for j in range(begin, end) if j != index)
        out.append((index - begin, others))
        index, level = index // fanout, level + 1
    return out


def fold(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf's digest and its siblings give."""
    for place, others in path:
        digest = H(others[: 64 * place], digest, others[64 * place :])
    return digest


def _written(path: list[tuple[int, str]]) -> str:
    return ";".join(f"{place}:{others}" for place, others in path)


def _read(path: str) -> list[tuple[int, str]]:
    return [(int(p), o) for p, o in (x.split(":") for x in path.split(";"))] if path else []


def _tier(base: int, levels: int, fanout: int, result):
    """The task for one block of `fanout` ** `levels` nodes of level `base`: gives each one's path to the root to `result`.

    The right side holds the block's nodes of these levels, and with level -1 the path above the block.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heights = sizes(left.column("size")[0].as_py(), fanout)
        found: dict[int, dict[int, str]] = {}
        above, tops = [], ("", "")
        for level, index, digest in zip(*(right.column(c).to_pylist() for c in ("level", "index", "digest")), strict=True):
            if level < 0:
                path, *tops = digest.split("|")
                above = _read(path)
            else:
                found.setdefault(level, {})[index] = digest
        if not base:
            found[0] = dict(zip(left.column("index").to_pylist(), left.column("digest").to_pylist(), strict=True))
        first = {level: min(at) for level, at in found.items()}
        digests = {level: [d for _, d in sorted(at.items())] for level, at in found.items()}
        stop = min(base + levels, len(heights) - 1)
        paths = (_path(i, base, digests, first, heights, fanout, stop) + above for i in left.column("index").to_pylist())
        return result(left, paths, tops)

    return run


def _by_block(left: DataFrame, right: DataFrame, task, schema: str, few: bool) -> DataFrame:
    """task(left, right) for each (tree, block), by a cogroup, or in one task where both sides are few rows."""
    if not few:
        return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(task, schema)
    both = left.withColumn("__left", F.lit(True)).unionByName(right.withColumn("__left", F.lit(False)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_of = [b for b in batches if b.num_rows]
        if not all_of:
            return
        rows = pa.Table.from_batches(all_of)
        places: dict[tuple, tuple[list[int], list[int]]] = {}
        for i, (tree, block, is_left) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("tree", "block", "__left")), strict=True)):
            places.setdefault((tree, block), ([], []))[0 if is_left else 1].append(i)
        for one, other in places.values():
            yield from task(rows.take(one), rows.take(other)).to_batches()

    return both.coalesce(1).mapInArrow(run, schema)


def proofs(forest: Forest, above: DataFrame, result, schema: str, scratch: Scratch, block: int = 4096) -> DataFrame:
    """`result` of each leaf with its path: siblings come from the node records, a block of leaves at a time.

    above: (tree, path), what lies over each tree's root, with words for `result` behind it. Blocks of leaves get the path
    over their block from blocks of blocks, so no task sees more than `block` nodes of a level, or _FEW rows in all.
    """
    f = forest.fanout
    k = max(1, int(math.log(block, f) + 1e-9))
    n_trees, tall, n = forest.roots.agg(F.count(F.lit(1)), F.max("size"), F.sum("size")).first()
    tiers = max(1, -(-(len(sizes(tall or 1, f)) - 1) // k))
    top = forest.roots.join(F.broadcast(above) if n_trees <= _FEW else above, "tree").select("tree", "size", "path")
    upper, out = None, None
    for tier in range(tiers - 1, -1, -1):
        base, span = tier * k, f**k
        items = forest.nodes.filter(f"level = {base} and size > {f**base}").select("tree", "size", "index", "digest") if tier else forest.leaves
        items = items.withColumn("block", F.expr(f"index div {span}"))
        items = items.toDF(*items.columns)  # columns of its own, as both sides may come from the node records
        inside = forest.nodes.filter(f"level >= {max(base, 1)} and level < {base + k} and size > {f**base}")
        inside = inside.select("tree", F.expr(f"index div cast({span} / power({f}, level - {base}) as long)").alias("block"), "level", "index", "digest")
        # blocks that reach the root of their tree have its path; the others that of their own place one tier up
        over = lambda rows, at: rows.select("tree", F.col(at).cast("long").alias("block"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("index"), F.col("path").alias("digest"))
        low = top.filter(f"size <= {f ** (base + k)} and size > {f**base if tier else 0}")
        inside = inside.unionByName(over(low.withColumn("at", F.lit(0)), "at"))
        if upper is not None:
            inside = inside.unionByName(over(upper, "index"))
        # nodes of a level: one of f**base leaves, and one more for each tree; its siblings above are fewer again
        few = 3 * ((n or 0) // f**base + n_trees) <= _FEW if tier else 3 * (n or 0) <= _FEW // 10
        if tier:

            def up(left: pa.Table, paths, tops) -> pa.Table:
                return pa.table({"tree": left.column("tree"), "index": left.column("index"), "path": ["|".join([_written(p), *tops]) for p in paths]})

            task, kind = _tier(base, k, f, up), "tree string, index long, path string"
        else:
            task, kind = _tier(base, k, f, result), schema
        out = _by_block(items, inside, task, kind, few)
        if tier:
            upper = scratch.put(out, f"tier-{len(scratch.names)}")
    return out


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digests(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, changed): each row's leaf, and with n_chars one larger where `tampered` says so (else null).

    A leaf is H of doc_id, source, lang, n_chars and text, each as its number of UTF-8 bytes, a colon and itself, or as - if null.
    """
    plain = F.sha2(F.concat(*(_field(F.col(c)) for c in FIELDS)), 256)
    more = F.sha2(F.concat(*(_field(F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c)) for c in FIELDS)), 256)
    changed = F.when(F.coalesce(tampered, F.lit(False)), more) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # null first, then bytewise
    return docs.select(tree.alias("tree"), "doc_id", plain.alias("digest"), changed.alias("changed"))


def manifest(docs: DataFrame, scratch: Scratch, fanout: int = 2, tampered: Column | None = None) -> tuple[Forest, Forest]:
    """The trees of all languages, and the one over their roots (null first, then bytewise).

    Leaves ascend by doc_id, null first; rows that share a doc_id by their digest. Null and empty values differ; repeated
    rows are leaves each; an empty table has no tree; columns other than the five are ignored.
    """
    by_lang = grow(leaf_digests(docs, tampered), [F.asc_nulls_first("doc_id")], fanout, scratch, "lang")
    over = by_lang.roots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest")
    return by_lang, grow(over, [F.col("member")], fanout, scratch, "over", few_trees=True)


def checked(docs: DataFrame, fanout: int = 2, tampered: Column | None = None, block: int = 4096) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    proof_sha256 is H of the leaf's siblings from its level up to the root; folded_root is the root that they give with the
    leaf as it is now (changed where `tampered`), and verified says that it is the manifest's. See manifest for nulls,
    ties, repeated rows and empty tables.
    """
    if fanout < 2:
        raise ValueError("a fanout of 2 at least")
    scratch = Scratch(docs.sparkSession, "merkle")
    by_lang, over = manifest(docs, scratch, fanout, tampered)

    def over_path(left: pa.Table, paths, tops) -> pa.Table:
        return pa.table({"tree": left.column("member"), "path": ["|".join([_written(p), d, *tops]) for p, d in zip(paths, left.column("digest").to_pylist(), strict=True)]})

    root = over.roots.select("tree", F.concat(F.lit("|"), "digest").alias("path"))
    above = scratch.put(proofs(over, root, over_path, "tree string, path string", scratch, block), "above")

    def judged(left: pa.Table, paths, tops) -> pa.Table:
        subroot, root = tops
        proof, folded = [], []
        for path, leaf, changed in zip(paths, left.column("digest").to_pylist(), left.column("changed").to_pylist(), strict=True):
            proof.append(H(*(others for _, others in path)))
            folded.append(fold(changed or leaf, path))
        n = left.num_rows
        return pa.table({"doc_id": left.column("doc_id"), "leaf": left.column("digest"), "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded, "verified": [x == root for x in folded]})

    kind = by_lang.leaves.schema["doc_id"].dataType.simpleString()
    out = proofs(by_lang, above, judged, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", scratch, block)
    out = scratch.put(out, "checked")
    scratch.drop_all_but("checked")
    return out


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of `documents` with fanout 2 and the check of every row, where rows whose id's crc32 7 divides are changed; see checked."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return checked(table(spark, sf_dir, "documents"), 2, tampered)


ORACLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars::HUGEINT AS n0, text,
         n_chars::HUGEINT + (doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 7 = 0)::INT AS n1 FROM documents),
fields AS (
  SELECT id, doc_id, lang, n0, n1, coalesce(strlen(text) || ':' || text, '-') AS tail,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head FROM docs),
hashed AS (
  SELECT id, doc_id, coalesce('=' || lang, '-') AS tree, sha256(head || coalesce(strlen(n0::VARCHAR) || ':' || n0::VARCHAR, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(n1::VARCHAR) || ':' || n1::VARCHAR, '-') || tail) AS now FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n),
subroots AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, i, n, d FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 2, n),
whole AS (SELECT d AS root FROM upper_nodes WHERE n = 1),
folded AS (
  SELECT id, l.tree, 0 AS level, false AS over, l.i, l.n, s.i AS j, s.n AS m, now AS d, '' AS siblings FROM leaves l JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.id, f.tree, CASE WHEN f.n > 1 OR f.over THEN f.level + 1 ELSE 0 END, f.over OR f.n = 1,
         CASE WHEN f.over OR f.n > 1 THEN f.i // 2 ELSE f.j END, CASE WHEN f.over OR f.n > 1 THEN (f.n + 1) // 2 ELSE f.m END, f.j, f.m,
         CASE WHEN NOT f.over AND f.n = 1 THEN f.d WHEN f.i % 2 = 0 THEN sha256(f.d || coalesce(x.d, u.d, '')) ELSE sha256(coalesce(x.d, u.d, '') || f.d) END,
         f.siblings || CASE WHEN NOT f.over AND f.n = 1 THEN '' ELSE coalesce(x.d, u.d, '') END
  FROM folded f
  LEFT JOIN nodes x ON NOT f.over AND x.tree = f.tree AND x.level = f.level AND x.i = xor(f.i, 1) AND f.n > 1
  LEFT JOIN upper_nodes u ON f.over AND u.level = f.level AND u.i = xor(f.i, 1) AND f.n > 1
  WHERE NOT (f.over AND f.n = 1))
SELECT l.doc_id, l.leaf, s.d AS subroot, root, sha256(f.siblings) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM folded f JOIN leaves l USING (id) JOIN subroots s ON s.tree = l.tree CROSS JOIN whole WHERE f.over AND f.n = 1"""
