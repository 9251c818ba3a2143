"""Editing locks as keyed state of a stream: taken, renewed by heartbeats, given up, granted to another, and dropped by a timer when they expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A lock lives so long after it was taken, renewed or granted.
TTL_SECONDS = 120
#: What comes of a request; `expired` has no request, a timer finds it.
OUTCOMES = ("taken", "renewed", "granted", "released", "read_only", "not_held", "self_grant", "ignored", "expired")

#: Columns of a request, and of what comes of it; in the keeper, times are microseconds.
REQUEST = "event_id long, document long, at timestamp, action string, actor long, target long"
RESULT = "event_id long, document long, at long, actor long, outcome string, holder long, expires long"
_LOCK = "holder long, expires long"
_WAITING = "event_id long, at long, action string, actor long, target long"


def step(lock: tuple[int, int] | None, at: int, action: str | None, actor: int | None, target: int | None, ttl: int) -> tuple[str, tuple[int, int] | None]:
    """(outcome, lock afterwards) of one request at a lock that has not expired by then; times in microseconds.

    open: takes a free lock, renews one's own, is read_only under another's. heartbeat, close and grant are the holder's
    alone (else not_held); a grant makes the target the holder, from now on, and not oneself. A request without an actor, a
    grant without a target and any other action are ignored.
    """
    if actor is None or action not in ("open", "heartbeat", "close", "grant") or (action == "grant" and target is None):
        return "ignored", lock
    if action == "open":
        return ("taken", (actor, at + ttl)) if lock is None else ("renewed", (actor, at + ttl)) if lock[0] == actor else ("read_only", lock)
    if lock is None or lock[0] != actor:
        return "not_held", lock
    if action == "heartbeat":
        return "renewed", (actor, at + ttl)
    if action == "close":
        return "released", None
    return ("self_grant", lock) if target == actor else ("granted", (target, at + ttl))


class LockKeeper(StatefulProcessor):
    """The lock of each document. Requests wait until the watermark has passed them, so that they count in order of time and id, however they came.

    State of a document: its lock, while it has one, and the requests that wait. Both go when the watermark passes them.
    """

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", _LOCK)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            requests = [tuple(None if pd.isna(v) else v for v in r) for r in zip(batch["event_id"], batch["at"], batch["action"], batch["actor"], batch["target"], strict=True)]
            requests = [(int(i), int(at), action, _whole(actor), _whole(target)) for i, at, action, actor, target in requests]
            self.waiting.appendList(requests)
            least = min(r[1] for r in requests)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(_due(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        lock = tuple(self.lock.get()) if self.lock.exists() else None
        out = []

        def expire(by: int):
            if lock is not None and lock[1] <= by:
                out.append((None, key[0], lock[1], lock[0], "expired", None, None))
                return None
            return lock

        later = [r for r in waiting if r[1] > now]
        seen = None
        for event_id, at, action, actor, target in waiting[: len(waiting) - len(later)]:
            if event_id == seen:  # a request that came twice is one
                continue
            seen = event_id
            lock = expire(at)
            outcome, lock = step(lock, at, action, actor, target, self.ttl)
            out.append((event_id, key[0], at, actor, outcome, lock and lock[0], lock and lock[1]))
        lock = expire(now)
        self.lock.update(lock) if lock else self.lock.clear()
        self.waiting.put(later) if later else self.waiting.clear()
        wake = [_due(later[0][1])] if later else []
        wake += [_due(lock[1])] if lock else []
        if wake:
            self.handle.registerTimer(min(wake))
        if out:
            frame = pd.DataFrame(out, columns=["event_id", "document", "at", "actor", "outcome", "holder", "expires"])
            for c in ("event_id", "actor", "holder", "at", "expires"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def _whole(v) -> int | None:
    return None if v is None else int(v)


def _due(at: int) -> int:
    """The first whole millisecond that is not before a time in microseconds."""
    return -(-at // 1000)


def locks(requests: DataFrame, ttl_seconds: float = TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """The stream of what comes of requests (REQUEST), and of expiries: (event_id, document, at, actor, outcome, holder, expires), in append mode.

    A request that is later than `late` behind the newest one is dropped; others count in order of time, then id, each id
    once a moment. Requests without an id, a document or a time are left out. A key's requests between two triggers are
    sorted in memory: bound a trigger by the source's rate. Runs on the RocksDB state store only (`activity.drain` with rocksdb).
    """
    rows = requests.filter("event_id is not null and document is not null and at is not null")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = rows.withColumn("at", micros).withColumn("due", F.timestamp_millis(F.ceil(F.col("at") / 1000))).withWatermark("due", late)
    found = rows.groupBy("document").transformWithStateInPandas(LockKeeper(ttl_seconds), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("at", "expires")})
