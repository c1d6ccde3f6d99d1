"""Exact quantiles by groups from histograms that close in on the ranks: no group's values meet anywhere.

Each rank that a quantile needs starts with its group's least and largest value. A pass counts the values between both in
equal bins (summed before the shuffle) and goes on with the bin that holds the rank, from its least to its largest value,
until few values are left there, or only one. What is kept is a row a rank and a pass's bins, whatever the values are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.sources import tables


def exact_quantiles(df: DataFrame, by: list[str], column: str, shares: list[float], bins: int = 1024, few: int = 10_000, broadcast_rows: int = 100_000) -> DataFrame:
    """(by ..., n, quantiles): the quantiles of a column at the given shares of 0 to 1, linear between neighbours, as a list.

    Nulls, NaN and infinite values are left out, a group with none else too; null group keys are a group; no groups give no
    rows. A bin of up to `few` values is sorted. Ranks go to every task up to broadcast_rows of them, else by a shuffle, in
    which a group that holds most rows is a skewed side that Spark splits.
    """
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares lie in 0 to 1")
    keys = [f"__k{i}" for i in range(len(by))]
    v = F.col(column).cast("double")
    values = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), v.alias("v")).filter("v is not null and not isnan(v) and v > double('-Infinity') and v < double('Infinity')")
    position = F.col("share") * (F.col("n") - 1)
    groups = tables.once(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    asked = groups.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares)))))
    ranks = asked.withColumn("rank", F.explode(F.array(F.floor(position), F.ceil(position)))).select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")).distinct()
    ranks = tables.once(ranks)
    n_ranks = ranks.count()

    def inside(targets: DataFrame) -> DataFrame:
        """The values in each target's bounds."""
        named = targets.withColumnsRenamed({k: f"{k}t" for k in keys})
        named = F.broadcast(named) if n_ranks <= broadcast_rows else named
        same = [F.col(k).eqNullSafe(F.col(f"{k}t")) for k in keys]
        return values.join(named, [*same, F.col("v").between(F.col("lo"), F.col("hi"))]).drop(*(f"{k}t" for k in keys))

    found, open_ = ranks.filter("lo = hi"), ranks.filter("lo < hi")
    wide = open_.filter(F.col("inside") > few)
    while not wide.isEmpty():
        # halves first, so that the widest range has a width
        place = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins
        binned = inside(wide).withColumn("bin", F.least(F.lit(bins - 1), F.floor(place).cast("int")))
        counts = binned.groupBy(*keys, "rank", "before", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        below = F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("bin")) - F.col("c")
        held = counts.withColumn("start", F.col("before") + below).filter((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("c")))
        closer = tables.once(held.select(*keys, "rank", "lo", "hi", F.col("start").alias("before"), F.col("c").alias("inside")))
        found = found.unionByName(closer.filter("lo = hi"))
        open_ = open_.filter(F.col("inside") <= few).unionByName(closer.filter("lo < hi"))
        wide = open_.filter(F.col("inside") > few)
    order = Window.partitionBy(*keys, "rank").orderBy("v")
    sorted_ = inside(open_).withColumn("__at", F.col("before") + F.row_number().over(order) - 1).filter("__at = rank")
    exact = found.select(*keys, "rank", F.col("lo").alias("v")).unionByName(sorted_.select(*keys, "rank", "v"))
    listed = exact.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    at = groups.join(listed.withColumnsRenamed({k: f"{k}t" for k in keys}), [F.col(k).eqNullSafe(F.col(f"{k}t")) for k in keys]) if keys else groups.crossJoin(listed)

    def quantile(share: float):
        p = F.lit(float(share)) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return low + (p - F.floor(p)) * (high - low)

    return at.select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=True)), "n", F.array(*map(quantile, shares)).alias("quantiles"))
