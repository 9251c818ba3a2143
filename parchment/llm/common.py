"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, writing

#: The white space of the contracts, `[\x20\x09-\x0D]`; bytes.split() without an argument splits on the same six.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
_LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, though body uses it often."""
    return F.transform(F.array(value), body)[0]


def stash(df: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, lost executors take nothing with them, and rows that were exchanged for it go.
    With `more`, a stashed table of the same columns, df is added to it."""
    spark = df.sparkSession
    path = more._stash_path if more else new_path(spark, "stash")
    with writing(spark):
        df.write.mode("append" if more else "error").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if (mine := _run.get()) is not None:
        mine.add(path)
    return out


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that no later step reads."""
    for df in frames:
        _delete(df.sparkSession, df._stash_path)


#: The tables stashed in the run that this thread of control is in; None outside of runs.
_run: ContextVar[set[str] | None] = ContextVar("stashed", default=None)


def stashed() -> frozenset[str]:
    """Begin a run: from now on the tables stashed by this thread of control, and by no other, are its own. It has none yet."""
    _run.set(set())
    return frozenset()


def sweep(keep: DataFrame, older: frozenset[str]) -> None:
    """Delete the tables of this run that were not there in `older`, but one, which is written and holds all that is still needed."""
    for path in (_run.get() or set()) - older - {keep._stash_path}:
        _delete(keep.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    if (mine := _run.get()) is not None:
        mine.discard(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def in_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema); a worker, which lives on for other tasks, gives the memory of a task back at its end."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return rows.mapInArrow(lean, schema)


class Recent:
    """A memory of the newest entries, of `room` bytes at most (about), and of those before, of as many. `new` is read directly, for speed."""

    def __init__(self, room: int):
        self.room, self.held = room, 0
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        if (found := self.new.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found, 0)
        return found

    def put(self, key, value, size: int) -> None:
        if self.held >= self.room:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[key] = value
        self.held += size + 220


def slices(batches, column: str, size: int = 4 << 20):
    """Batches cut into parts of about `size` bytes of a column of texts, binaries or lists; a longer value is a part by itself."""
    for batch in batches:
        offsets = np.frombuffer(batch[column].buffers()[1], np.int64 if pa.types.is_large_string(batch[column].type) else np.int32)[batch[column].offset :][: batch.num_rows + 1] if batch.num_rows else np.zeros(1)
        width = 4 if pa.types.is_list(batch[column].type) else 1
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size // width, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_LOWER_ASCII).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words, from the words' hashes; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    run = min(k, n)
    out = np.full(n - run + 1, run, np.uint64)
    for i in range(run):
        out = mix(out + words[i : n - run + 1 + i])
    return out


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
