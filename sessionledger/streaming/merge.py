"""A table that micro-batches are merged into.

Rows lie in hash buckets of their key. A merge reads and rewrites only the buckets
that its batch touches, each into a new folder, and then puts up a manifest (bucket
to folder, newest batch) by one rename. Readers take the newest manifest, so they see a batch
whole or not at all, and a batch that is given again changes nothing. What a failed
merge has left no manifest names; ``vacuum`` deletes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runs import started

BUCKET = "_bucket"


def newest(key: str, order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Per key the row of largest ``order``; of equal ones that of the table stays, of those
    within a batch the first by its other columns."""

    def merged(table: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in table.columns if c not in (key, *order)]
        own = lambda df, old: df.select(key, F.struct(*order, F.lit(old).alias("_old")).alias("_o"), F.struct(F.lit(0).alias("_"), *rest).alias("_r"))
        # One aggregation, combined before the shuffle: the least rest of every order, then the top order.
        least = own(table, 1).unionByName(own(batch, 0)).groupBy(key, "_o").agg(F.min("_r").alias("_r"))
        best = least.groupBy(key).agg(F.max(F.struct("_o", "_r")).alias("_b"))
        return best.select(key, "_b._o.*", "_b._r.*").select(*table.columns)

    return merged


def replaced(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A batch's row takes the place of the table's; a batch has one row per key."""

    def merged(table: DataFrame, batch: DataFrame) -> DataFrame:
        keys = batch.select(F.col(key).alias("_key"))
        return table.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(batch)

    return merged


class MergeTable:
    """``merge(batch, batch_id)`` fits ``foreachBatch``; ``read()`` is the table as it stands."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, rule: Callable, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.rule, self.buckets = spark, path, schema, key, rule, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests
    def manifest(self) -> dict:
        """The newest manifest: version, batch, and the folder that holds each bucket."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return {"version": 0, "batch": -1, "buckets": {}}
        last = max((f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")), default=None)
        if last is None:
            return {"version": 0, "batch": -1, "buckets": {}}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{last}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put_up(self, manifest: dict) -> None:
        name = f"{self.path}/manifests/{manifest['version']:020d}"
        draft = self._path(name + ".draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path(name + ".json")):
            raise RuntimeError(f"another merge has put up version {manifest['version']} of {self.path}")

    def folder(self, name: str, bucket: int) -> str:
        return f"{self.path}/data/{name}/{BUCKET}={bucket}"

    # -- rows
    def _rows(self, buckets: dict) -> DataFrame:
        paths = [self.folder(v, int(b)) for b, v in buckets.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest()["buckets"])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        now = self.manifest()
        if batch_id <= now["batch"]:
            return
        at = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        batch = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        batch.persist()
        try:
            touched = [r[0] for r in batch.select(at.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
            version, name = now["version"] + 1, uuid.uuid4().hex
            if touched:
                held = {b: now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]}
                merged = self.rule(self._rows(held), batch)
                merged.withColumn(BUCKET, at).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
            self._put_up({"version": version, "batch": batch_id, "buckets": now["buckets"] | {str(b): name for b in touched}})
        finally:
            batch.unpersist()

    def vacuum(self) -> None:
        """Delete buckets and manifests that the newest manifest does not name; no reader may hold an older one."""
        now = self.manifest()
        kept = {self.folder(name, int(b)) for b, name in now["buckets"].items()}
        data = self._path(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for b in range(self.buckets):
                folder = self.folder(f.getPath().getName(), b)
                if folder not in kept:
                    self._fs.delete(self._path(folder), True)
        for version in range(1, now["version"]):
            self._fs.delete(self._path(f"{self.path}/manifests/{version:020d}.json"), False)


def run_merged(stream: DataFrame, table: MergeTable, checkpoint: str, mode: str = "update") -> DataFrame:
    """Merge all that has landed into ``table`` and read it."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(table.merge).option("checkpointLocation", checkpoint)
    started(writer, stream.sparkSession).awaitTermination()
    return table.read()
