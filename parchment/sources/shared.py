"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: exchanged rows go as soon as it is there, and tables dealt out by one key are joined by it and more as they lie.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="parchment-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as it is now, kept by a checkpoint in the shared folder: what it was made from is not run again, and lost executors take nothing with them."""
    context, folder = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings under which a table is written that is read from there on; what they were before comes back."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df kept in the shared folder, dealt out by `key`: tables kept so are grouped and joined by it, or by it and more, without an exchange when the next is written."""
    spark = df.sparkSession
    path = new_path(spark, "dealt")
    name = path.rpartition("/")[2].replace("-", "_")
    with writing(spark):
        df.write.option("path", path).option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    out = spark.read.table(name)
    out._dealt = name, path
    return out


def undealt(*frames: DataFrame) -> None:
    """Delete tables kept by dealt() that no later step reads."""
    for df in frames:
        spark, (name, path) = df.sparkSession, df._dealt
        spark.sql(f"drop table if exists {name}")
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
