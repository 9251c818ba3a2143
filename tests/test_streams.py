"""Keyed state and joined streams: order, late and repeated rows, expiry, and what state is left."""

import datetime as dt

import pytest

from parchment.sources.shared import new_path
from parchment.streaming import activity as A
from parchment.streaming.locks import REQUEST, locks, step

NOON = dt.datetime(2024, 5, 1, 12)


def at(minutes: float) -> dt.datetime:
    return NOON + dt.timedelta(minutes=minutes)


def fed(spark, folder, batches, schema):
    """A stream of one file a batch, in order of writing."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, stream, rocksdb=False):
    path = new_path(spark, "test")
    A.drain(stream, A.append(path), "append", rocksdb)
    return spark.read.parquet(path).select(*stream.columns).collect()


FAR = (99, 9, at(1000), "open", 1, None)


def test_lock_requests_count_in_order_however_they_come(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "open", 1, None), (3, 1, at(1.5), "heartbeat", 1, None), (4, 1, at(2), "open", 2, None)],
        # Before the last two, and one that came twice.
        [(2, 1, at(1), "open", 2, None), (4, 1, at(2), "open", 2, None), (5, 1, at(3), "grant", 1, 2), (6, 1, at(4), "close", 2, None), (7, 1, at(4.5), "close", 2, None)],
        [(8, 1, at(5), "open", 3, None), (9, 1, at(20), "heartbeat", 3, None), (10, 1, at(20), "grant", None, 2), (11, 1, at(20), "open", None, None), (12, 1, at(20), "dance", 3, None), (13, 1, at(20), "open", 4, None), (14, 1, at(20.5), "grant", 4, 4), (None, 1, at(21), "open", 1, None), (15, None, at(21), "open", 1, None), (16, 1, None, "open", 1, None)],
        [(97, 9, at(31), "open", 1, None)],
        [(17, 1, at(2.5), "close", 1, None), FAR],  # the first is behind the watermark of the batch before, and dropped
    ]
    rows = drained(spark, locks(fed(spark, tmp_path / "r", batches, REQUEST), late="10 minutes"), rocksdb=True)
    got = [(r.event_id, r.outcome, r.holder) for r in sorted(rows, key=lambda r: (r.at, r.event_id is not None, r.event_id)) if r.document == 1]
    assert got == [
        (1, "taken", 1), (2, "read_only", 1), (3, "renewed", 1), (4, "read_only", 1), (5, "granted", 2), (6, "released", None), (7, "not_held", None),
        (8, "taken", 3), (None, "expired", None), (9, "not_held", None), (10, "ignored", None), (11, "ignored", None), (12, "ignored", None), (13, "taken", 4), (14, "self_grant", 4), (None, "expired", None),
    ]
    expiry = [r for r in rows if r.outcome == "expired" and r.document == 1]
    assert sorted((r.at, r.actor) for r in expiry) == [(at(7), 3), (at(22), 4)]


def test_lock_state_is_dropped_at_expiry(spark, tmp_path):
    stream = locks(fed(spark, tmp_path / "r", [[(1, 1, at(0), "open", 1, None), (2, 2, at(0), "open", 1, None)], [FAR], [(98, 9, at(1001), "close", 1, None), (100, 9, at(1003), "open", 2, None)], [(101, 9, at(1004), "close", 2, None)]], REQUEST))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", A.ROCKSDB)
    try:
        q = stream.writeStream.format("memory").queryName("kept_locks").option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert q.lastProgress.stateOperators[0].numRowsTotal == 0
    assert spark.table("kept_locks").filter("outcome = 'expired'").count() == 2


@pytest.mark.parametrize(
    ("lock", "request_", "outcome", "after"),
    [
        (None, ("open", 1, None), "taken", (1, 12)),
        ((1, 5), ("open", 1, None), "renewed", (1, 12)),
        ((2, 5), ("open", 1, None), "read_only", (2, 5)),
        (None, ("heartbeat", 1, None), "not_held", None),
        ((2, 5), ("close", 1, None), "not_held", (2, 5)),
        ((1, 5), ("close", 1, None), "released", None),
        ((1, 5), ("grant", 1, 3), "granted", (3, 12)),
        ((1, 5), ("grant", 1, 1), "self_grant", (1, 5)),
        ((1, 5), ("grant", 1, None), "ignored", (1, 5)),
    ],
)
def test_lock_step(lock, request_, outcome, after):
    assert step(lock, 2, *request_, 10) == (outcome, after)


def test_work_in_flight_until_its_first_end_or_for_the_window(spark, tmp_path):
    schema = "event_id long, document long, at timestamp"
    queued = fed(spark, tmp_path / "q", [[(1, 1, at(0)), (2, 1, at(40)), (3, 2, at(0))], [(4, 3, at(41)), (5, None, at(41))], [(6, 9, at(500))]], schema)
    # An end before the start counts for nothing; one that comes in a later batch, at the window's edge, counts.
    ended = fed(spark, tmp_path / "e", [[(11, 1, at(-1)), (12, 1, at(10))], [(13, 1, at(70)), (14, 2, at(31)), (15, 3, at(41)), (16, 3, at(50))], [(17, 9, at(600))]], schema)
    rows = drained(spark, A.in_flight(queued, ended, late="1 hour"))
    assert sorted((r.event_id, r.end_id or 0) for r in rows) == [(1, 12), (2, 13), (3, 0), (4, 15), (4, 16)]
