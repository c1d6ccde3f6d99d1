"""Where operators keep written tables, and small helpers on DataFrames."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.sources.tables import shared_dir


def written(df: DataFrame, name: str, *by: str, **options: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run, in a folder of their own; they are deleted by name or, but for some, all at once."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df, written and read again: cuts lineage and survives lost executors."""
        path = f"{self.at}/{name}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.at}/{name}")
            self.names.discard(name)

    def drop_all_but(self, *kept: str) -> None:
        self.drop(*self.names.difference(kept))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts of finished steps, which it does when their plans are collected."""
    for _ in range(2):  # plans first, then the shuffles that only they referred to
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front where a column is called so already (Spark does not tell case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns and the text, null texts as empty ones."""
    return docs.select(*cols, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def input_mb(df: DataFrame) -> float:
    """Megabytes that the optimizer expects df to hold (for a scan: the sizes of its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6
