"""A table of rows by key that is changed by upserts and deletes: kept in buckets of keys, of which a change rewrites only those that it touches.

A manifest names the folder of each bucket. A change writes new folders first, then the next manifest; readers follow the newest one, so
they see a change whole or not at all. A change that was stopped before its manifest leaves only folders that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Changed:
    """Keys that a change added, updated, left as they were and deleted, and those in the table after it."""

    added: int
    updated: int
    unchanged: int
    deleted: int
    total: int


class KeyedTable:
    """Rows of `schema` by `key`, in `buckets` buckets, in a folder that driver and executors share. Choose buckets so that one fits a task."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def read(self) -> DataFrame:
        """The rows as of the newest manifest."""
        return self._rows(self._manifest()[1])

    def upsert(self, rows: DataFrame) -> Changed:
        """Put rows in, each in the place of the one with its key. Of rows with equal keys the largest, by all columns, counts; null keys go.

        Rows that are there already change nothing: a change that runs again touches no bucket.
        """
        rows = rows.select(*self.schema.names).filter(F.col(self.key).isNotNull())
        best = rows.groupBy(self.key).agg(F.max(F.struct(*self.schema.names)).alias("new"))
        return self._change(best)

    def delete(self, keys: DataFrame) -> Changed:
        """Take the rows with these keys out; keys that are not there change nothing."""
        gone = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        return self._change(gone.withColumn("new", F.lit(None).cast(self.schema)))

    def _change(self, wanted: DataFrame) -> Changed:
        """`wanted` is (key, new): the row that shall be there, or null for none."""
        version, folders = self._manifest()
        old = self._rows(folders).select(F.col(self.key), F.struct(*self.schema.names).alias("old"))
        both = wanted.join(old, self.key, "left")
        kind = F.when(F.col("new").isNull(), F.when(F.col("old").isNotNull(), "deleted")).when(F.col("old").isNull(), "added").when(F.col("new") == F.col("old"), "unchanged").otherwise("updated")
        judged = both.select(self.key, kind.alias("kind"), self._bucket().alias("bucket")).filter("kind is not null")
        counts = judged.groupBy("bucket", "kind").count().collect()  # a row a bucket and kind
        touched = sorted({r.bucket for r in counts if r.kind != "unchanged"})
        of = {k: sum(r["count"] for r in counts if r.kind == k) for k in ("added", "updated", "unchanged", "deleted")}
        if touched:
            folder = f"{self.path}/{uuid.uuid4().hex}"
            before = self._rows({b: f for b, f in folders.items() if b in touched}).select(self.key, F.struct(*self.schema.names).alias("old"))
            merged = wanted.withColumn("asked", F.lit(True)).join(before, self.key, "full_outer").withColumn("bucket", self._bucket())
            # A key that was asked for has its new row, or none; another keeps its old one.
            row = F.when(F.col("asked"), F.col("new")).otherwise(F.col("old"))
            left = merged.filter(F.col("bucket").isin(touched)).select(row.alias("row"), "bucket").filter("row is not null").select("row.*", "bucket")
            left.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
            self._publish(version, folders | {b: f"{folder}/bucket={b}" for b in touched})
        return Changed(*(of[k] for k in ("added", "updated", "unchanged", "deleted")), total=self.read().count())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        there = [f for f in folders.values() if self._exists(f)]  # a bucket that lost all its rows has no folder
        return self.spark.read.schema(self.schema).parquet(*there) if there else self.spark.createDataFrame([], self.schema)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """(version, folder of each bucket); version 0 without a manifest."""
        there = self._fs().globStatus(self._path(f"{self.path}/manifest-*.json")) or []
        names = sorted(s.getPath().toString() for s in there)
        if not names:
            return 0, {}
        text = self.spark.read.text(names[-1], wholetext=True).first()[0]
        found = json.loads(text)
        return found["version"], {int(b): f for b, f in found["buckets"].items()}

    def _publish(self, version: int, folders: dict[int, str]) -> None:
        """Write the next manifest beside its place, and move it there; fails if another change was first."""
        fs, name = self._fs(), f"{self.path}/manifest-{version + 1:012d}.json"
        beside = self._path(f"{self.path}/next-{uuid.uuid4().hex}.json")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps({"version": version + 1, "buckets": folders}).encode()))
        out.close()
        if fs.exists(self._path(name)) or not fs.rename(beside, self._path(name)):
            raise RuntimeError(f"version {version + 1} is there already: the table was changed meanwhile")
