"""Stored tables: appends, whole replacement, and keys that a repeated run does not add twice."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from terralens.operators.catalog import new_rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and all runs on one machine (tests, a laptop) a local folder is chosen once for the session; on a
    cluster that would lose rows, so it raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints", f"terralens-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def once(df: DataFrame, *by: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read again, so that all readers see the same rows; in folders by the named columns."""
    path = f"{shared_dir(df.sparkSession)}/once-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows; none while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, *by: str) -> None:
    """One atomic commit for all rows."""
    (df.write.partitionBy(*by) if by else df.write).mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str, schema: str) -> int:
    """Appends the rows whose key is not stored yet; how many they are."""
    spark = df.sparkSession
    fresh = new_rows(df, read(spark, path, schema), key).persist()
    n = fresh.count()
    if n:
        append(fresh, path)
    fresh.unpersist()
    return n


def replace(df: DataFrame, path: str) -> None:
    """Replaces a table that df may be read from: rows are written beside it before the old ones go."""
    spark = df.sparkSession
    side = f"{path}-{uuid.uuid4().hex}"
    df.write.parquet(side)
    spark.read.parquet(side).write.mode("overwrite").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(side)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_blobs(df: DataFrame, path: str) -> None:
    """(path, content) as a Parquet table by the path's first folder: objects without a file each."""
    df.withColumn("folder", F.element_at(F.split("path", "/"), -2)).write.mode("append").partitionBy("folder").parquet(path)
