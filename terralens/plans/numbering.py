"""Row numbers and running sums in a total order without one task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.sources import tables


def numbered(df: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """df with `row`, from 1 in the given order (in each group of `by`).

    Groups are numbered in a window each. One order over all rows is cut into ranges: rows are numbered in their range,
    and each range starts where the ones before it end, which is a sum over one row a range.
    """
    if by:
        return df.withColumn("row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # written once: ranges come from a sample, so both readers must see the same ones
    ranged = tables.once(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return inside.join(F.broadcast(before), "__part").withColumn("row", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def batches(df: DataFrame, order: list[Column], size: int = 256) -> DataFrame:
    """df with `batch`, the number of its batch of `size` rows, from 0."""
    return numbered(df, order).withColumn("batch", F.floor((F.col("row") - 1) / size))
