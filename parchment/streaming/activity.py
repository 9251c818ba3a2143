"""Streams over the activity log: windows, sessions and idempotent appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path


def activity(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The log, a file or a folder, as a stream of files; files_per_trigger bounds a batch (the rate limit)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path}*")  # a pattern: the source takes a plain path for a folder


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windows(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by event type and tumbling window; events later than `late` may be left out once their window is closed."""
    per = _timed(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """Runs of a user's events that follow each other within `gap`."""
    per = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def expired_drafts(saves: DataFrame, live: str = "24 hours", late: str = "0 seconds") -> DataFrame:
    """(user_id, first, last, expires, saves) of each draft of a user that was not saved again within `live`; the stream drops it then.

    In append mode a draft comes out once the watermark has passed its expiry, and its state goes with it: that is the purge.
    """
    per = _timed(saves, late).groupBy(F.session_window("ts", live), "user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("saves"))
    return per.select("user_id", "first", "last", F.col("session_window.end").alias("expires"), "saves")


def append_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer for foreachBatch: appends the rows whose keys the table at `path` does not hold, once each.

    A batch that runs again, whole or in part, adds nothing twice: its rows are found in the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = batch.dropDuplicates(keys)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            held = spark.read.schema(batch.schema).parquet(path).select(*keys)
            new = new.join(held, keys, "left_anti")
        new.write.mode("append").parquet(path)

    return write


def replace(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for complete results: each batch takes the place of the last."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(path)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for append mode: a folder a batch, so that a batch that runs again takes the place of its first run."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def in_flight(queued: DataFrame, ended: DataFrame, window: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """The stream of (event_id, document, at, end_id, end_at): each start of work with each end of it within `window`, or with nulls if there is none.

    Both streams are (event_id, document, at timestamp). A start is in flight from `at` on until its first end, or for the whole window; an end at
    the same moment counts. Rows later than `late` behind the newest of either stream may be dropped. A start without an end comes
    out once both watermarks have passed its window; then its state, and that of the ends before, is dropped.
    """
    q = queued.filter("document is not null and at is not null").withWatermark("at", late)
    e = ended.select(F.col("event_id").alias("end_id"), F.col("document").alias("end_document"), F.col("at").alias("end_at")).filter("end_document is not null and end_at is not null").withWatermark("end_at", late)
    within = F.expr(f"document = end_document and end_at >= at and end_at <= at + interval {window}")
    return q.join(e, within, "left_outer").select("event_id", "document", "at", "end_id", "end_at")


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, rocksdb: bool = False) -> None:
    """Run a stream over all that its source holds now, with its checkpoint in the shared folder; with `rocksdb`, its state is kept by RocksDB."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if rocksdb:
        spark.conf.set(key, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "stream")).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if rocksdb:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
