"""Table schemas and the rules that their rows must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BBOX = "struct<lon_min:double,lat_min:double,lon_max:double,lat_max:double>"
POINT = "struct<lon:double,lat:double>"
SOURCE_TILES = f"id string, product_id string, bbox {BBOX}, date_acq timestamp, cloud_cover double, path string, status string, created_at timestamp"
PATCHES = f"patch_id long, source_tile_id string, center {POINT}, bbox {BBOX}, path string, patch_size int, gsd_m double, created_at timestamp"
DESCRIPTORS = "patch_id long, idx int, x float, y float, desc array<float>"
VECTORS = "patch_id long, method string, vec array<float>"
TASKS = "id string, type string, status string, params string, result string, error string, created_at timestamp, updated_at timestamp"


def bbox_valid(box: Column) -> Column:
    """Corners in order and inside the globe."""
    lon = (box["lon_min"] < box["lon_max"]) & (box["lon_min"] >= -180) & (box["lon_max"] <= 180)
    return lon & (box["lat_min"] < box["lat_max"]) & (box["lat_min"] >= -90) & (box["lat_max"] <= 90)


def patch_faults(patches: DataFrame) -> DataFrame:
    """(patch_id, fault): each broken rule of each patch."""
    rules = {
        "bbox": ~bbox_valid(F.col("bbox")),
        "gsd_m": ~((F.col("gsd_m") > 0) & (F.col("gsd_m") <= 100)),
        "patch_size": F.col("patch_size") <= 0,
        "source_tile_id": F.col("source_tile_id").isNull(),
    }
    found = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()))
    return patches.select("patch_id", F.explode(F.array_compact(found)).alias("fault"))


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key has no parent (a null key is no fault)."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
