"""Tables that change by key: immutable files, and numbered snapshots that say which of them count.

A change (rows to put, keys to delete) is written beside what is there and becomes visible with the next snapshot, a small
file that is renamed into place. A reader holds the files of one snapshot, so a merge, a compaction or a writer that dies
never leaves it without a table or with half of a change. Reads merge the changes into the base; compaction writes that
down. The rename must not replace a file that exists, as in HDFS; on a local disk two writers could race for an instant.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Snapshot:
    """version 0 is the empty table. base and changes are folders; a change has its number of rows too."""

    version: int
    base: str | None
    changes: tuple[tuple[str, int], ...]


class SnapshotTable:
    """A table at `path` with one row a key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, broadcast_rows: int = 500_000) -> None:
        self.spark, self.path, self.key, self.broadcast_rows = spark, path.rstrip("/"), key, broadcast_rows
        self.schema: StructType = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- snapshots

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return Snapshot(0, None, ())
        if version not in known:
            raise ValueError(f"no version {version}")
        text = self.spark.read.text(self._name(version), wholetext=True).first()[0]
        found = json.loads(text)
        return Snapshot(version, found["base"], tuple((c[0], c[1]) for c in found["changes"]))

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:020d}.json"

    def _publish(self, s: Snapshot) -> bool:
        """Whether s became its version; False if another writer was first."""
        side = self._at(f"{self.path}/versions/{uuid.uuid4().hex}.side")
        out = self._fs.create(side, False)
        out.write(bytearray(json.dumps({"base": s.base, "changes": s.changes}).encode()))
        out.close()
        if not self._fs.exists(self._at(self._name(s.version))) and self._fs.rename(side, self._at(self._name(s.version))):
            return True
        self._fs.delete(side, False)
        return False

    # --- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version (default: the last). What is returned goes on reading that version's files, whatever is written."""
        s = self.snapshot(version)
        base = self.spark.read.schema(self.schema).parquet(s.base) if s.base else self.spark.createDataFrame([], self.schema)
        if not s.changes:
            return base
        names, out = self.schema.names, None
        for number, (folder, _) in enumerate(s.changes):
            one = self.spark.read.schema(self._change_schema()).parquet(folder).withColumn("__at", F.lit(number))
            out = one if out is None else out.unionByName(one)
        last = out.groupBy(self.key).agg(F.max_by(F.struct("__gone", *(n for n in names if n != self.key)), "__at").alias("__last"))
        rows = sum(n for _, n in s.changes)
        keys = last.select(self.key)
        kept = base.join(F.broadcast(keys) if rows <= self.broadcast_rows else keys, self.key, "left_anti").select(*names)
        put = last.filter("not __last.__gone").select(*(F.col(n) if n == self.key else F.col(f"__last.{n}").alias(n) for n in names))
        return kept.unionByName(put)

    def _change_schema(self) -> StructType:
        return StructType([*self.schema.fields]).add("__gone", "boolean")

    # --- writing

    def _change(self, rows: DataFrame) -> int:
        """Appends a change; the version that holds it. What others published meanwhile comes before it."""
        none = F.raise_error(F.lit(f"a null {self.key}"))
        named = rows.withColumn(self.key, F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(none.cast(self.schema[self.key].dataType)))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        named.write.parquet(folder)
        n = self.spark.read.schema(self._change_schema()).parquet(folder).count()
        while True:
            s = self.snapshot()
            if self._publish(Snapshot(s.version + 1, s.base, (*s.changes, (folder, n)))):
                return s.version + 1

    def put(self, rows: DataFrame) -> int:
        """Inserts rows, or replaces those that have their keys; of rows that share a key the greatest counts, column by column."""
        names = [n for n in self.schema.names if n != self.key]
        one = rows.select(*self.schema.names).groupBy(self.key).agg(F.max(F.struct(*names)).alias("r"))
        return self._change(one.select(*(F.col(n) if n == self.key else F.col(f"r.{n}").alias(n) for n in self.schema.names), F.lit(False).alias("__gone")))

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows that have the keys; keys that no row has do nothing."""
        nulls = [F.col(n) if n == self.key else F.lit(None).cast(self.schema[n].dataType).alias(n) for n in self.schema.names]
        return self._change(keys.select(self.key).distinct().select(*nulls, F.lit(True).alias("__gone")))

    def compact(self) -> int | None:
        """Writes the merged rows as the new base; its version, None where there was nothing to do or another writer was first."""
        s = self.snapshot()
        if not s.changes:
            return None
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self.read(s.version).write.parquet(folder)
        return s.version + 1 if self._publish(Snapshot(s.version + 1, folder, ())) else None

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but the last `keep`, and all folders that none of these hold; how many folders went.

        Readers of older versions, and writers that have not published yet, lose their files: run it when there are none.
        """
        known = self.versions()
        held = {f for v in known[-keep:] for s in [self.snapshot(v)] for f in (s.base, *(c for c, _ in s.changes)) if f}
        for v in known[:-keep]:
            self._fs.delete(self._at(self._name(v)), False)
        folder, gone = self._at(f"{self.path}/data"), 0
        names = {f.rsplit("/", 1)[-1] for f in held}
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName() not in names:
                gone += self._fs.delete(status.getPath(), True)
        return gone
