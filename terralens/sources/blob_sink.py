"""format("blob_files"): rows (path, content) as files under one folder, all of them or none.

Tasks write below a pending folder of the job; the commit moves files to their places, the abort deletes the folder, so a
task that fails or is tried again leaves nothing half-written. Paths are relative and stay inside the folder; a path that
stands twice in a job is an error before anything is moved, and a file that is there is replaced. The folder is one that
driver and executors reach as files.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from terralens.operators.image import from_struct, geotiff_encode


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where the task put a file, and its path


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://").removeprefix("file:").rstrip("/")
        self.pending = f"{self.root}/_pending-{uuid.uuid4().hex}"
        os.makedirs(self.pending)  # here only: a task that outlives the abort must not make it again

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, files = f"{self.pending}/{uuid.uuid4().hex}", []  # of this try of the task
        for b in iterator:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                clean = os.path.normpath(path or "")
                if not path or clean.startswith(("/", "..")) or clean == ".":
                    raise ValueError(f"not a path inside the folder: {path}")
                if not files:
                    os.mkdir(folder)
                name = f"{folder}/{len(files)}"
                with open(name, "wb") as f:
                    f.write(content or b"")
                files.append((name, clean))
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        seen: set[str] = set()
        for _, path in files:
            if path in seen:
                self.abort(messages)
                raise ValueError(f"{path} stands twice")
            seen.add(path)
        for name, path in files:
            os.makedirs(os.path.dirname(f"{self.root}/{path}"), exist_ok=True)
            os.replace(name, f"{self.root}/{path}")
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[Written]) -> None:
        for _ in range(50):  # tasks that still run may put a file into a folder that is being emptied
            shutil.rmtree(self.pending, ignore_errors=True)
            if not os.path.exists(self.pending):
                return
            time.sleep(0.1)


class BlobSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blob_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write_files(rows: DataFrame, folder: str) -> None:
    """rows (path, content) as files under the folder."""
    rows.sparkSession.dataSource.register(BlobSink)
    rows.select("path", "content").write.format("blob_files").mode("append").save(folder)


def geotiffs(rasters: DataFrame) -> DataFrame:
    """(path, content): rasters (path, image, west, north, px, py, epsg) as GeoTIFF files; null images are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in b.to_pylist() if r["image"] is not None]
            content = [geotiff_encode(from_struct(r["image"]), r["west"], r["north"], (r["px"], r["py"]), r["epsg"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows], pa.string()), pa.array(content, pa.binary())], ["path", "content"])

    return rasters.select("path", "image", "west", "north", "px", "py", "epsg").mapInArrow(run, "path string, content binary")
