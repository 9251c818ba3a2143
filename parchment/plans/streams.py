"""Streams over the events table, each drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import new_path
from ..sources.tables import load
from ..streaming import activity as A
from ..streaming.locks import locks
from .registry import query


def _drained(spark, stream, write, mode, rocksdb=False):
    """The table that a drained stream leaves."""
    path = new_path(spark, "drained")
    A.drain(stream, write(path), mode, rocksdb)
    return spark.read.parquet(path).select(*stream.columns)


@query("select event_id, user_id, event_type from events")
def t3_idempotent_append(spark, sf_dir):
    """The log appended twice by two streams: the second adds nothing."""
    path = new_path(spark, "log")
    for _ in range(2):
        rows = A.activity(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
        A.drain(rows, A.append_new(path, ["event_id"]), "append")
    return spark.read.parquet(path)


@query("select date_trunc('day', ts) as start, event_type, count(*) n from events group by 1, 2")
def t_daily_windows(spark, sf_dir):
    """An extension: tumbling windows in event time."""
    return _drained(spark, A.windows(A.activity(spark, f"{sf_dir}/events.parquet")), A.replace, "complete")


@query("""with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval 1 day, true) opens from events),
    s as (select user_id, ts, sum(case when opens then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) k from g)
    select user_id, min(ts) as start, count(*) n from s group by user_id, k""")
def t_sessions(spark, sf_dir):
    """An extension: sessions of each user, closed by a day without events."""
    return _drained(spark, A.sessions(A.activity(spark, f"{sf_dir}/events.parquet")), A.replace, "complete")


@query("select distinct user_id, event_type from events")
def t8_once_per_run(spark, sf_dir):
    """Each pair of user and event type is passed on once."""
    rows = A.activity(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type")
    return _drained(spark, rows, lambda path: A.append_new(path, ["user_id", "event_type"]), "append")


@query("select event_id from events where ts > (select max(ts) from events) - interval 24 hour")
def t6_unexpired_drafts(spark, sf_dir):
    """What a purge leaves: rows less than a day older than the newest."""
    rows = load(spark, sf_dir, "events", "event_id", "ts")
    newest = rows.agg(F.max("ts") - F.expr("interval 24 hours")).scalar()
    return rows.filter(F.col("ts") > newest).select("event_id")


@query("""with h as (select event_id, user_id, ts, ts + interval 120 second until, lag(ts) over (partition by user_id order by ts, event_id) before from events)
    select event_id, before is null or before + interval 120 second <= ts taken from h""")
def t5_lock_taken(spark, sf_dir):
    """Whether an event takes a user's lock anew, or renews one that the event before it holds for 120 seconds."""
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "events", "event_id", "user_id", "ts")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.withColumn("before", before).select("event_id", (F.col("before").isNull() | (F.col("before") + F.expr("interval 120 seconds") <= F.col("ts"))).alias("taken"))


#: What the log's event types ask of a lock, and how long one lives there: the log has about an event of a user in seven hours.
_ACTIONS = {"signup": "open", "view": "open", "click": "heartbeat", "error": "close", "purchase": "grant"}
_TTL_HOURS = 12


@query(f"""with recursive e as (
        select event_id, user_id as document, ts t, case event_type when 'signup' then 'open' when 'view' then 'open' when 'click' then 'heartbeat' when 'error' then 'close' when 'purchase' then 'grant' end as action,
            cast(json_extract(props, '$.k') as bigint) % 3 actor, (cast(json_extract(props, '$.k') as bigint) + 1) % 3 target, row_number() over (partition by user_id order by ts, event_id) n from events),
    s as (
        select distinct document, 0::bigint n, null::bigint event_id, null::timestamp t, null::bigint actor, null::varchar outcome, null::bigint holder, null::timestamp expires from e
        union all
        select document, n, event_id, t, actor, outcome,
            case when outcome in ('taken', 'renewed') then actor when outcome = 'granted' then target when outcome = 'released' then null else held end,
            case when outcome in ('taken', 'renewed', 'granted') then t + interval {_TTL_HOURS} hour when outcome = 'released' then null else until end
        from (select *, case when action = 'open' then case when held is null then 'taken' when held = actor then 'renewed' else 'read_only' end
                when held is null or held <> actor then 'not_held' when action = 'heartbeat' then 'renewed' when action = 'close' then 'released' else 'granted' end outcome
            from (select e.*, case when s.expires > e.t then s.holder end held, case when s.expires > e.t then s.expires end until from s join e on e.document = s.document and e.n = s.n + 1))),
    x as (select null::bigint event_id, document, expires t, holder actor, 'expired' outcome, null::bigint holder, null::timestamp expires
        from (select *, lead(t) over (partition by document order by n) next, (select max(t) from e) newest from s) where expires <= coalesce(next, newest))
    select event_id, document, t as "at", actor, outcome, holder, expires from s where n > 0 union all select * from x""")
def t5_lock_states(spark, sf_dir):
    """A lock a user over the whole log: what comes of each request, and each expiry, from keyed state with event-time timers."""
    events = A.activity(spark, f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    action = F.element_at(F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair]), F.col("event_type"))
    asked = events.select("event_id", F.col("user_id").alias("document"), F.col("ts").alias("at"), action.alias("action"), (k % 3).alias("actor"), ((k + 1) % 3).alias("target"))
    found = _drained(spark, locks(asked, _TTL_HOURS * 3600), A.append, "append", rocksdb=True)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "expires")})


@query("""with q as (select event_id, user_id, ts from events where event_type = 'signup'), d as (select event_id, user_id, ts from events where event_type in ('purchase', 'error')),
    w as (select least((select max(ts) from q), (select max(ts) from d)) newest),
    j as (select q.event_id, q.user_id as document, q.ts t, min(d.ts) end_at, arg_min(d.event_id, (d.ts, d.event_id)) end_id from q left join d on d.user_id = q.user_id and d.ts >= q.ts and d.ts <= q.ts + interval 30 minute group by all)
    select event_id, document, t as "at", end_id, coalesce(end_at, t + interval 30 minute) until from j, w where end_id is not null or t + interval 30 minute < newest""")
def t7_in_flight(spark, sf_dir):
    """From when to when each queued piece of work was in flight, by a join of two streams: until its first end event, or for 30 minutes.

    Work whose 30 minutes both streams have not passed yet is still open, and comes out later."""
    events = A.activity(spark, f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("document"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    queued, ended = events.filter("event_type = 'signup'").drop("event_type"), events.filter("event_type in ('purchase', 'error')").drop("event_type")
    pairs = _drained(spark, A.in_flight(queued, ended), A.append, "append")
    first = F.min(F.when(F.col("end_id").isNotNull(), F.struct("end_at", "end_id")))
    work = pairs.groupBy("event_id", "document", "at").agg(first.alias("e"))
    until = F.coalesce(F.col("e.end_at"), F.col("at") + F.expr("interval 30 minutes"))
    return work.select("event_id", "document", F.col("at").cast("timestamp_ntz").alias("at"), F.col("e.end_id").alias("end_id"), until.cast("timestamp_ntz").alias("until"))


@query("""with d as (select user_id, ts from events where event_type in ('view', 'click')), g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 24 hour, true) opens from d), s as (select *, sum(opens::integer) over (partition by user_id order by ts rows unbounded preceding) k from g),
    x as (select user_id, min(ts) first, max(ts) last, max(ts) + interval 24 hour expires, count(*) saves from s group by user_id, k) select * from x where expires <= (select max(ts) from d)""")
def t6_expired_drafts(spark, sf_dir):
    """Drafts that were purged, a day after their last save: sessions of a stream, in append mode, so that what is still alive stays in state."""
    saves = A.activity(spark, f"{sf_dir}/events.parquet").filter("event_type in ('view', 'click')").select("user_id", "ts")
    found = _drained(spark, A.expired_drafts(saves), A.append, "append")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last", "expires")})
