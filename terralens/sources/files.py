"""Images, blobs, archives and band files, read through Spark's own readers."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff")


def images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """(image): decoded pictures in blue, green, red order; broken ones are kept with empty data, or dropped."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(path)


def blobs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of all files under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)


def patch_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder, by name: (name, path, content)."""
    files = blobs(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files.filter(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*SUFFIXES)).select("name", "path", "content").orderBy("name")


def existing(rows: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """rows with `exists`: whether a file lies at their path."""
    there = files.select(F.col("path").alias(key)).distinct().withColumn("exists", F.lit(True))
    return rows.join(there, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def with_blobs(rows: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """rows with the content of the file at their path."""
    return rows.join(files.select(F.col("path").alias(key), "content"), key)


def band_files(paths: DataFrame, bands: tuple[str, ...] = ("B02", "B03", "B04"), resolution: str = "R10m") -> DataFrame:
    """(product, B02, B03, B04): each product's band files, the `resolution` folder's first, else any other's.

    paths (path). A product lacking a band raises an error.
    """
    named = paths.select("path", F.regexp_extract("path", r"([^/]+)\.SAFE/", 1).alias("product"), F.regexp_extract("path", r"_(B\d[0-9A])(?:_\d+m)?\.jp2$", 1).alias("band"))
    ours = named.filter(F.col("band").isin(*bands)).withColumn("order", F.when(F.col("path").contains(f"/{resolution}/"), 0).otherwise(1))
    best = ours.groupBy("product", "band").agg(F.min(F.struct("order", "path")).alias("b"))
    wide = best.groupBy("product").pivot("band", list(bands)).agg(F.first("b.path"))
    need = lambda b: F.when(F.col(b).isNotNull(), F.col(b)).otherwise(F.raise_error(F.concat(F.lit(f"no {b} in "), F.col("product"))).cast("string"))
    return wide.select("product", *(need(b).alias(b) for b in bands))


def unzipped(files: DataFrame) -> DataFrame:
    """(archive, name, content): the members of zip archives (path, content); an archive that holds nothing is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    members = [m for m in z.infolist() if not m.is_dir()]
                    if not members:
                        raise ValueError(f"nothing in {path}")
                    for m in members:  # one at a time, for archives are large
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([m.filename]), pa.array([z.read(m)], pa.binary())], ["archive", "name", "content"])

    return files.select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def retried(call: Callable, tries: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """call() with waits of 1, 2, 4 ... times first_wait between tries; the last error is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(first_wait * 2**k)


def fetched(requests: DataFrame, fetch: Callable[[dict], bytes], workers: int = 8, tries: int = 3, stored: DataFrame | None = None, key: str = "path") -> DataFrame:
    """requests with `content` and `err`: what fetch gives for each row, `workers` tasks side by side.

    fetch runs in the tasks: a download, a window of a remote raster, an export block. Failing rows keep their message.
    Requests whose key is in `stored` already are left out, so a repeated run only fetches what is missing.
    """
    if stored is not None:
        requests = requests.join(stored.select(key).distinct(), key, "left_anti").select(*requests.columns)
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, errors = [], []
            for row in b.to_pylist():
                try:
                    got.append(retried(lambda row=row: fetch(row), tries))
                    errors.append(None)
                except Exception as e:  # reported in the row
                    got.append(None)
                    errors.append(str(e)[:200] or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary()), pa.array(errors, pa.string())], [*names, "content", "err"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in requests.schema)
    return requests.repartition(workers).mapInArrow(run, f"{kinds}content binary, err string")
