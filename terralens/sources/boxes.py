"""Stored boxes that a search skips by file: rows along a space-filling curve, and each file's bounds in a small table.

Centers of boxes get a number by interleaving the bits of their grid cells, so rows that are near on the curve are near on
the map. Files hold runs of the curve, and a box query reads those whose bounds it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
BOUNDS = ("lon_min", "lat_min", "lon_max", "lat_max")


def _spaced(cell: Column) -> Column:
    """The bits of a number of up to 16 bits, a free bit between each two."""
    out = cell.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = (out.bitwiseOR(F.shiftleft(out, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return out


def curve(lon: Column, lat: Column) -> Column:
    """A place's number on the curve, 32 bits: degrees are cut to a grid of 65,536 cells a side; null where a coordinate is."""
    cell = lambda x, low, span: F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((x - low) / span * (1 << BITS))))
    known = lon.isNotNull() & lat.isNotNull()
    return F.when(known, _spaced(cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spaced(cell(lat, -90.0, 180.0)), 1)))


def write_boxes(rows: DataFrame, path: str, files: int) -> None:
    """rows (with lon_min .. lat_max) in about `files` files along the curve, and their bounds beside them.

    Rows of one place may be most of the table; a random part of the order splits them.
    """
    z = curve((F.col("lon_min") + F.col("lon_max")) / 2, (F.col("lat_min") + F.col("lat_max")) / 2)
    ordered = rows.withColumn("__z", z).repartitionByRange(files, "__z", F.xxhash64(*rows.columns)).sortWithinPartitions("__z")
    ordered.drop("__z").write.parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    of = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(*(F.min(c).alias(c) if c.endswith("min") else F.max(c).alias(c) for c in BOUNDS), F.count(F.lit(1)).alias("n"))
    of.coalesce(1).write.parquet(f"{path}/bounds")


def files_in(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> list[str]:
    """The files whose bounds meet the box (borders count)."""
    a, b, c, d = box
    met = spark.read.parquet(f"{path}/bounds").filter((F.col("lon_max") >= a) & (F.col("lon_min") <= c) & (F.col("lat_max") >= b) & (F.col("lat_min") <= d))
    return sorted(r[0] for r in met.select("file").collect())


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Stored rows whose box meets the given one (borders count); only files that can hold some are opened. Rows without bounds meet nothing."""
    a, b, c, d = box
    found = files_in(spark, path, box)
    whole = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(whole.schema).parquet(*found) if found else whole.limit(0)
    return rows.filter((F.col("lon_max") >= a) & (F.col("lon_min") <= c) & (F.col("lat_max") >= b) & (F.col("lat_min") <= d))


def meeting(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """asked (lon_min .. lat_max and more) with the stored rows that meet each: one row a pair, the stored columns prefixed where names clash.

    Only files whose bounds some asked box meets are opened, and boxes meet on grid cells, not all with all.
    """
    from terralens.operators.tiling import box_join

    bounds = spark.read.parquet(f"{path}/bounds")
    files = sorted(r[0] for r in box_join(bounds.select("file", *BOUNDS), asked.select(*BOUNDS), 10.0).select("file").distinct().collect())
    whole = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    met = box_join(asked, rows, 2.0)
    return met.withColumnsRenamed({f"r_{c}": c for c in rows.columns if c not in asked.columns})
