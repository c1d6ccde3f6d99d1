"""An extension: patches that arrive as files, encoded and added to the index's lists as they come.

Repeated products within the watermark are dropped, a batch is appended at most once (its id is part of the path), and
the last status of each task is kept as state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of files (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(path)


def once(stream: DataFrame, key: str = "path", time: str = "modificationTime", delay: str = "1 hour") -> DataFrame:
    """The stream without rows whose key came within `delay` before; state is bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def into_lists(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Encodes each batch and writes its lists; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(stream: DataFrame, time: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): events by tumbling window and type; late ones count while the watermark allows."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_status(stream: DataFrame, key: str = "user_id", time: str = "ts", status: str = "event_type") -> DataFrame:
    """The last status of each key so far, for an output that keeps whole results."""
    return stream.groupBy(key).agg(F.max(F.struct(time, status)).alias("m")).select(key, F.col(f"m.{time}").alias(time), F.col(f"m.{status}").alias(status))
