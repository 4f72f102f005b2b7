"""A partitioned table with atomic merges: staged files, and a manifest that says which of them are the table.

A merge reads and writes the partitions that incoming rows touch, nothing else. What it writes is invisible until the next manifest is
renamed into place, which one writer of several can do; a run that dies leaves the old version. Rows that change nothing write nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vintra.operators.writes import upsert, upsert_status


@dataclass(frozen=True)
class Merged:
    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    partitions: int = 0


class MergedTable:
    """Rows under `path`, one a key, in partitions by a column of the key (all in one if None). Nulls in a key are values."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], partition_by: str | None = None):
        if partition_by is not None and partition_by not in key:
            raise ValueError("the partition column must be one of the key, or a key could be in two partitions")
        self.spark, self.path, self.key, self.partition_by = spark, path.rstrip("/"), key, partition_by

    def _fs(self, at: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _partition(self) -> Column:
        """A folder's name for each value: safe in any path."""
        return F.lit("all") if self.partition_by is None else F.md5(F.coalesce(F.concat(F.lit("="), F.col(self.partition_by).cast("string")), F.lit("null")))

    def version(self) -> int:
        """The number of the newest manifest, 0 without one."""
        fs, at = self._fs(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self) -> dict:
        """{schema, partitions: {name: [folders]}} of the newest version."""
        if not (n := self.version()):
            return {"schema": None, "partitions": {}}
        text = self.spark.read.text(f"{self.path}/manifest/v{n}.json", wholetext=True).first()["value"]
        return json.loads(text)

    def read(self, partitions: list[str] | None = None) -> DataFrame | None:
        """The table, or some of its partitions; None before the first merge."""
        m = self.manifest()
        if m["schema"] is None:
            return None
        folders = [f"{self.path}/{x}" for p, of in sorted(m["partitions"].items()) if partitions is None or p in partitions for x in of]
        schema = StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def insert(self, incoming: DataFrame) -> Merged:
        """Adds the rows whose key isn't there; of several with one key any one."""
        return self._merge(incoming, None, None)

    def upsert(self, incoming: DataFrame, values: list[str], last: str | None = None) -> Merged:
        """Inserts new keys and replaces rows that differ in `values`; of several with one key the one with the greatest `last` counts, or any one."""
        return self._merge(incoming, values, last)

    def _merge(self, incoming: DataFrame, values: list[str] | None, last: str | None) -> Merged:
        before, m = self.version(), self.manifest()
        schema = StructType.fromJson(m["schema"]) if m["schema"] else incoming.schema
        rows = incoming.select(*schema.names)
        rows = rows.groupBy(*self.key).agg(F.max_by(F.struct(*schema.names), last).alias("_r")).select("_r.*") if last else rows.dropDuplicates(self.key)
        touched = [r["p"] for r in rows.select(self._partition().alias("p")).distinct().collect()]
        old = self.read(touched)
        old = self.spark.createDataFrame([], schema) if old is None else old
        stage, counted = f"data/{uuid.uuid4().hex}", Observation()
        compared = upsert_status(old, rows, self.key, values or self.key)
        counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("inserted", "updated", "unchanged")]
        changed = compared.observe(counted, *counts).where("status <> 'unchanged'").withColumn("_p", self._partition())
        changed.write.partitionBy("_p").parquet(f"{self.path}/{stage}")
        seen = counted.get
        if not seen["inserted"] and not seen["updated"]:
            self._drop(stage)
            return Merged(unchanged=seen["unchanged"])
        new = self.spark.read.schema(changed.schema).parquet(f"{self.path}/{stage}")
        state = {r["_p"]: r["updates"] for r in new.groupBy("_p").agg((F.count(F.when(F.col("status") == "updated", 1)) > 0).alias("updates")).collect()}
        partitions = dict(m["partitions"])
        for p, updates in state.items():
            if not updates:
                partitions[p] = [*partitions.get(p, []), f"{stage}/_p={p}"]
        if again := [p for p, updates in state.items() if updates]:
            whole = f"data/{uuid.uuid4().hex}"
            kept = upsert(self.read(again), new.where(F.col("_p").isin(again)).select(*schema.names), self.key)
            kept.withColumn("_p", self._partition()).write.partitionBy("_p").parquet(f"{self.path}/{whole}")
            partitions |= {p: [f"{whole}/_p={p}"] for p in again}
        self._commit(before + 1, {"schema": json.loads(schema.json()), "partitions": partitions})
        return Merged(seen["inserted"], seen["updated"], seen["unchanged"], len(state))

    def _commit(self, n: int, manifest: dict) -> None:
        """Makes a version the newest one; fails if another writer has made it meanwhile."""
        fs, staged = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest/v{n}.json")
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, False)
            raise RuntimeError(f"version {n} of {self.path} was written by another merge; run this one again")

    def _drop(self, folder: str) -> None:
        fs, at = self._fs(f"{self.path}/{folder}")
        fs.delete(at, True)

    def vacuum(self) -> int:
        """Deletes staged folders that the newest version doesn't use, and older manifests; not while another merge or an old reader runs. Returns their number."""
        m, n = self.manifest(), self.version()
        used = {x.split("/")[1] for of in m["partitions"].values() for x in of}
        fs, data = self._fs(f"{self.path}/data")
        gone = [s.getPath().getName() for s in fs.listStatus(data) if s.getPath().getName() not in used]
        for name in gone:
            self._drop(f"data/{name}")
        for k in range(1, n):
            self._drop(f"manifest/v{k}.json")
        return len(gone)
