"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm._tables import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): each node of an edge and the least node that it can reach.

    Each round links every node's larger neighbours to its least one, then its smaller ones; a graph of n nodes is all
    stars after about log(n) rounds. Rounds are written to the shared folder, each in place of the one before; nothing is
    collected but a checksum.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    run = uuid.uuid4().hex
    now = scratch.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{run}-0")
    before = _state(now)
    for step in itertools.count(1):
        # large star: neighbours above u go to the least of u and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: u and its neighbours below go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = scratch.put(small.filter("a <> b").distinct(), f"{run}-{step}")
        scratch.drop(f"{run}-{step - 1}")
        state = _state(now)
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
