"""Tables of source tiles, patches and tasks: look-ups and idempotent changes.

Tables are DataFrames; a change gives the new table, and write() replaces a stored one as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch_meta(patches: DataFrame) -> DataFrame:
    """What results show of a patch: center, corners and path."""
    c, b = F.col("center"), F.col("bbox")
    return patches.select(
        "patch_id", c["lon"].alias("center_lon"), c["lat"].alias("center_lat"), F.array(b["lon_min"], b["lat_min"], b["lon_max"], b["lat_max"]).alias("bbox"), F.col("path")
    )


def by_ids(patches: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of the named patches with what hits know of them, such as the rank, so that order is not lost.

    Hits are a top-k result; adaptive execution broadcasts them while they are small.
    """
    return hits.filter(F.col("patch_id") != -1).join(patches, "patch_id")


def with_parent(patches: DataFrame, tiles: DataFrame, contains: str | None = None, patch_size: int | None = None) -> DataFrame:
    """Patches with their tile's product_id, filtered by a part of it and by size."""
    if patch_size is not None:
        patches = patches.filter(F.col("patch_size") == patch_size)
    parents = tiles.select(F.col("id").alias("source_tile_id"), "product_id")
    if contains is not None:
        parents = parents.filter(F.col("product_id").contains(contains))
    return patches.join(parents, "source_tile_id")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not there yet, once each; what a repeated load adds."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def without(df: DataFrame, key: str, value) -> DataFrame:
    """df without the rows of a key's value; rows with a null key stay."""
    return df.filter(~F.col(key).eqNullSafe(F.lit(value)))


def deletion_report(df: DataFrame, key: str, value, order: str, sample: int = 5) -> DataFrame:
    """What a deletion would do: (n, first): the number of rows and the first few by `order`."""
    hit = df.filter(F.col(key) == value)
    first = hit.orderBy(order).limit(sample).agg(F.array_sort(F.collect_list(order)).alias("first"))
    return hit.agg(F.count(F.lit(1)).alias("n")).crossJoin(first)


def merge_status(tasks: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """tasks with updates applied: columns that an update leaves null keep their value; the last update of a task wins.

    updates hold the key, updated_at and some of the other columns; unknown tasks are ignored.
    """
    fields = [c for c in updates.columns if c in tasks.columns and c != key]
    w = Window.partitionBy(key).orderBy("updated_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = updates.select(key, *(F.last(c, ignorenulls=True).over(w).alias(f"__{c}") for c in fields)).dropDuplicates([key])
    merged = tasks.join(last, key, "left")
    return merged.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in tasks.columns))


def latest(events: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The last event of each key, as a partial aggregate: no window, no sort."""
    top = events.groupBy(key).agg(F.max(F.struct(*order, *keep)).alias("__m"))
    return top.select(key, *(F.col(f"__m.{c}").alias(c) for c in keep))


def page(df: DataFrame, order: list[Column], top: int, skip: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(top)


def health(components: DataFrame, name: str = "name", status: str = "status") -> DataFrame:
    """(status, n, failing): ok if all components are, else degraded."""
    ok = F.col(status).startswith("ok")
    return components.agg(F.when(F.coalesce(F.bool_and(ok), F.lit(True)), F.lit("ok")).otherwise(F.lit("degraded")).alias("status"), F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("failing"))


def uploads(files: DataFrame, most_mb: int = 50) -> DataFrame:
    """Uploaded files (name, content_type, data) with the code that answers them: 415, 413, 422 or 200."""
    kinds = ("image/jpeg", "image/png", "image/tiff")
    code = (
        F.when(F.col("data").isNull(), 422).when(~F.coalesce(F.col("content_type"), F.lit("")).isin(*kinds), 415).when(F.octet_length("data") > most_mb * 1024 * 1024, 413).otherwise(200)
    )
    return files.withColumn("code", code)


def random_rows(df: DataFrame, key: str, n: int = 1, seed: int = 42) -> DataFrame:
    """n rows picked by a hash of their key and the seed: as good as at random, and the same in every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
