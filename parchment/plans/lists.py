"""Document lists by their exact rules: pages, filters, tabs, counters, merging by name, dispatch and saves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import listing, review
from ..sources.tables import load
from .derived import derived, derived_sql
from .registry import query

_LIST = derived_sql("listed")
_STATUSES, _OFFSET, _LIMIT = ["extracted", "classified", "nowhere"], 20, 500


@query(_LIST + f""", f as (select * from listed where not deleted and folder in ('x1', 'x2', 'x3', 'x7') and extraction_status in ('extracted', 'classified') and review_status in ('in_review', 'pending') and contains(lower(reviewer), 'user') and contains(lower(name), lower('Order 1')))
    select id, name, created, (select count(*) from f) total, (select count(*) from f) > {_OFFSET + 200} has_more, ['nowhere'] as unknown from f order by created desc, id desc limit 200 offset {_OFFSET}""")
def f1_document_page(spark, sf_dir):
    """A page of a filtered list, newest first, with its total (O1); a limit above 200 gives 200, unknown statuses are told (U6)."""
    allowed = ["extracted", "classified", "published", "extracted_with_warnings", "rejected"]
    rows = derived(spark, sf_dir, "listed").filter(~F.col("deleted") & F.col("folder").isin("x1", "x2", "x3", "x7") & F.col("extraction_status").isin(*_STATUSES) & F.col("review_status").isin("in_review", "pending"))
    rows = rows.filter(F.contains(F.lower("reviewer"), F.lit("user")) & F.contains(F.lower("name"), F.lower(F.lit("Order 1")))).select("id", "name", "created")
    unknown = F.array(*map(F.lit, listing.unknown(_STATUSES, allowed)))
    return listing.page(rows, [F.desc("created"), F.desc("id")], _LIMIT, _OFFSET).withColumn("unknown", unknown)


@query("with w as (select unnest(['true', 'no', 'maybe']) param) select param, doc_id from w, documents d where case param when 'true' then doc_id in (select doc_id from labels) when 'no' then doc_id not in (select doc_id from labels where doc_id is not null) else true end")
def f2_classified_three_ways(spark, sf_dir):
    """Documents with a label, without one, and, where the parameter says neither, all: a semi-join, an anti-join, none."""
    docs, labels = load(spark, sf_dir, "documents", "doc_id"), load(spark, sf_dir, "labels", "doc_id")
    found = [("true", docs.join(labels, "doc_id", "left_semi")), ("no", docs.join(labels, "doc_id", "left_anti")), ("maybe", docs)]
    out = None
    for param, rows in found:
        rows = rows.select(F.lit(param).alias("param"), "doc_id")
        out = rows if out is None else out.union(rows)
    return out


_WIN = "case when n.pub <> h.pub then n.pub when n.cls <> h.cls then n.cls else (n.ext and not h.ext) or n.pages > h.pages end"


@query(_LIST + f""", k as (select id, created, case when trim(coalesce(name, ''), ' ') = '' then '#' || id else '=' || lower(trim(name, ' ')) end as key, extraction_status = 'published' pub, extraction_status = 'classified' or has_run cls, extraction_status in ('extracted', 'extracted_with_warnings') ext, coalesce(pages, 0) pages from listed),
    o as (select *, row_number() over (partition by key order by created, id) r from k),
    h as (select key, r, id, pub, cls, ext, pages from o where r = 1 union all select n.key, n.r, case when {_WIN} then n.id else h.id end, case when {_WIN} then n.pub else h.pub end, case when {_WIN} then n.cls else h.cls end, case when {_WIN} then n.ext else h.ext end, case when {_WIN} then n.pages else h.pages end from h join o n on n.key = h.key and n.r = h.r + 1)
    select h.key, h.id, f.created first_created, f.id first_id from h join o f on f.key = h.key and f.r = 1 where h.r = (select max(r) from o x where x.key = h.key)""")
def w12_merged_by_name(spark, sf_dir):
    """The row that wins for each name, and the place of the first row of that name."""
    found = listing.one_of_each_name(derived(spark, sf_dir, "listed"), ["created", "id"])
    return found.select("key", "id", F.col("place.created").alias("first_created"), F.col("place.id").alias("first_id"))


_TAB_SQL = ["needs_review > 0 or status = 'Needs review'", "status = 'In review' or coalesce(current_reviewer, '') <> ''", "status = 'Draft' or extraction_status = 'rejected'", "status = 'Saved'", "status = 'Reviewed'", "extraction_status = 'extracted'", "extraction_status = 'extracted_with_warnings' or warned", "extraction_status = 'rejected'", "status in ('Published', 'Updated to vector DB') or review_status = 'published'"]


@query(_LIST + " " + " union all ".join(f"select '{t}' tab, id from listed where {c}" for t, c in zip(listing.TABS, _TAB_SQL, strict=True)))
def f26_tabs(spark, sf_dir):
    """The rows of each tab of the document list; a row may be in several. One pass over the list."""
    inside = F.array_compact(F.array(*[F.when(c, t) for t, c in zip(listing.TABS, listing.tabs(), strict=True)]))
    return derived(spark, sf_dir, "listed").select(F.explode(inside).alias("tab"), "id")


@query(_LIST + " select count(*) all_, " + ", ".join(f"count(*) filter ({c}) {t.replace('-', '_')}" for t, c in zip(listing.TABS, _TAB_SQL, strict=True)) + """, count(*) filter (lower(extraction_status) not in ('classified', 'published')) queue, count(*) filter (lower(extraction_status) in ('classified', 'published') or status = 'Saved') done,
    count(*) filter (extraction_status in ('extracted', 'extracted_with_warnings', 'pending')) processing from listed""")
def a26_document_counters(spark, sf_dir):
    """The counters of the list's tabs, of the queue and of what is done (F32, A27), in one aggregate."""
    status = F.lower("extraction_status")
    counts = [F.count_if(c).alias(t.replace("-", "_")) for t, c in zip(listing.TABS, listing.tabs(), strict=True)]
    done = status.isin("classified", "published")
    return derived(spark, sf_dir, "listed").agg(F.count(F.lit(1)).alias("all_"), *counts, F.count_if(~done).alias("queue"), F.count_if(done | (F.col("status") == "Saved")).alias("done"), F.count_if(status.isin("extracted", "extracted_with_warnings", "pending")).alias("processing"))


_FIELDS = ("name", "title", "parties", "reviewer", "folder", "agreement", "sector")


@query(_LIST + " select id from listed where " + " or ".join(f"contains(lower({f}), 'r 12')" for f in _FIELDS))
def f28_seven_field_search(spark, sf_dir):
    """Rows that hold the search text in any of seven fields, literally."""
    hits = [F.coalesce(F.contains(F.lower(f), F.lit("r 12")), F.lit(False)) for f in _FIELDS]
    return derived(spark, sf_dir, "listed").filter(F.array_contains(F.array(*hits), True)).select("id")


@query(derived_sql("listed") + """, e as (select event_id, user_id, ts, event_type, cast(json_extract(props, '$.k') as bigint) % 2 = 0 classify from events), now as (select user_id, max(ts) now from e group by 1),
    q as (select e.user_id, arg_max(e.ts, (e.ts, e.event_id)) at_, arg_max(classify, (e.ts, e.event_id)) classify from e join now using (user_id) where event_type = 'signup' and ts >= now - interval 12 hour group by 1),
    fl as (select user_id, not exists (select 1 from e where e.user_id = q.user_id and e.ts >= q.at_ and (e.event_type in ('purchase', 'error') or e.event_type = 'view' and not q.classify)) in_flight from q)
    select id, case when refused then 'rejected' when changed then 'to_ingest' when due and coalesce(in_flight, false) then 'in_flight' when due then 'to_ingest' else 'none' end bucket, refused and (changed or extraction_status <> 'rejected' or not has_run) recorded from listed left join fl on user_id = id % 150""")
def r2_dispatch_plan(spark, sf_dir):
    """What a synchronisation queues, leaves in flight and refuses, and which refusals it records.

    In flight is a document whose latest queue event in the window before its newest event has no end at or after it (J17); where that event asked for no
    classification, a further event ends it. The window is 12 hours, as the log has an event of a document in seven hours."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = load(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "props").withColumn("classify", k % 2 == 0)
    now = e.groupBy("user_id").agg(F.max("ts").alias("now"))
    order = F.struct("ts", "event_id")
    queued = e.filter("event_type = 'signup'").join(now, "user_id").filter(F.col("ts") >= F.col("now") - F.expr("interval 12 hours")).groupBy("user_id").agg(F.max_by("ts", order).alias("at"), F.max_by("classify", order).alias("asked"))
    newest = lambda test: F.max(F.when(test, F.col("ts")))
    ends = e.groupBy("user_id").agg(newest(F.col("event_type").isin("purchase", "error")).alias("end"), newest(F.col("event_type") == "view").alias("short_end"))
    ended = F.coalesce(F.col("end") >= F.col("at"), F.lit(False)) | (~F.col("asked") & F.coalesce(F.col("short_end") >= F.col("at"), F.lit(False)))
    flight = queued.join(ends, "user_id").select("user_id", (~ended).alias("in_flight"))
    rows = derived(spark, sf_dir, "listed").withColumn("user_id", F.col("id") % 150).join(flight, "user_id", "left")
    bucket = F.when(F.col("refused"), "rejected").when(F.col("changed"), "to_ingest").when(F.col("due") & F.coalesce("in_flight", F.lit(False)), "in_flight").when(F.col("due"), "to_ingest").otherwise("none")
    recorded = F.col("refused") & (F.col("changed") | (F.col("extraction_status") != "rejected") | ~F.col("has_run"))
    return rows.select("id", bucket.alias("bucket"), recorded.alias("recorded"))


@query(_LIST + " select id, sha1(concat_ws('|', id, coalesce(name, ''), extraction_status, coalesce(pages::varchar, ''), deleted)) etag from listed")
def f25_fingerprints(spark, sf_dir):
    """A fingerprint of what a row shows, for conditional fetches (X17)."""
    parts = [F.col("id").cast("string"), F.coalesce("name", F.lit("")), F.col("extraction_status"), F.coalesce(F.col("pages").cast("string"), F.lit("")), F.col("deleted").cast("string")]
    return derived(spark, sf_dir, "listed").select("id", F.sha1(F.concat_ws("|", *parts)).alias("etag"))


_ITEMS = derived_sql("items")


@query(_ITEMS + """, c as (select *, coalesce(note = 'why', false) chosen, edited is not null or decision is null changed from items), d as (select *, bool_or(chosen) over w any_chosen, bool_or(changed) over w any_changed from c window w as (partition by run_id))
    select run_id, ord from d where case when any_chosen then chosen when any_changed then changed else true end""")
def f38_rows_to_save(spark, sf_dir):
    """Of each run: the chosen rows; if none is chosen, those that were edited or never saved; if there are none either, all."""
    rows = derived(spark, sf_dir, "items").select("run_id", "ord", F.coalesce(F.col("note") == "why", F.lit(False)).alias("chosen"), (F.col("edited").isNotNull() | F.col("decision").isNull()).alias("changed"))
    of = rows.groupBy("run_id").agg(F.bool_or("chosen").alias("any_chosen"), F.bool_or("changed").alias("any_changed"))
    keep = F.when(F.col("any_chosen"), F.col("chosen")).when(F.col("any_changed"), F.col("changed")).otherwise(True)
    return rows.join(of, "run_id").filter(keep).select("run_id", "ord")


@query(_ITEMS + " select run_id, count(*) filter (decision is not null and not deleted) reviewed, count(*) filter (not deleted) total, round(100.0::double * count(*) filter (decision is not null and not deleted) / nullif(count(*) filter (not deleted), 0), 1) pct from items group by 1")
def a9_reviewed_share(spark, sf_dir):
    """Decided of live items, a run."""
    live = ~F.col("deleted")
    rows = derived(spark, sf_dir, "items").groupBy("run_id").agg(F.count_if(live & F.col("decision").isNotNull()).alias("reviewed"), F.count_if(live).alias("total"))
    return rows.withColumn("pct", F.round(100.0 * F.col("reviewed") / F.nullif("total", F.lit(0)), 1))


@query(_LIST + " select folder, string_agg(distinct reviewer, ',' order by reviewer) reviewers, count(distinct reviewer) n from listed where not deleted group by 1")
def a8_reviewers_of_folders(spark, sf_dir):
    """The distinct reviewers of each folder's live documents, in order."""
    rows = derived(spark, sf_dir, "listed").filter(~F.col("deleted")).groupBy("folder").agg(F.sort_array(F.collect_set("reviewer")).alias("r"))
    return rows.select("folder", F.nullif(F.array_join("r", ","), F.lit("")).alias("reviewers"), F.size("r").cast("long").alias("n"))


@query(_LIST + """, r as (select extraction_status, name, id, row_number() over (partition by extraction_status order by id) n, count(*) over (partition by extraction_status) total from listed)
    select extraction_status, string_agg(id::varchar, ',' order by n) ids, greatest(any_value(total) - 40, 0) remaining from r where n <= 40 group by 1""")
def o10_details(spark, sf_dir):
    """The first 40 documents of each status, and how many more there are; top lists of salted parts are merged."""
    rows = derived(spark, sf_dir, "listed").select("extraction_status", "id", F.pmod(F.xxhash64("id"), F.lit(32)).alias("part"))
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter("n <= 40")
    top = first(first(rows, "extraction_status", "part").drop("n"), "extraction_status")
    totals = rows.groupBy("extraction_status").agg(F.count(F.lit(1)).alias("total"))
    ids = top.groupBy("extraction_status").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    return ids.join(totals, "extraction_status").select("extraction_status", "ids", F.greatest(F.col("total") - 40, F.lit(0)).alias("remaining"))


@query("select p_type category, max(p_size) + 1 next_number, count(*) n from part group by 1 union all select 'none', coalesce(max(p_size), 0) + 1, count(*) from part where p_type = 'none'")
def a29_next_numbers(spark, sf_dir):
    """The next number of each category, and of one that has none yet (A30)."""
    part = load(spark, sf_dir, "part", "p_type", "p_size")
    of = part.groupBy(F.col("p_type").alias("category")).agg((F.max("p_size") + 1).alias("next_number"), F.count(F.lit(1)).alias("n"))
    none = part.filter("p_type = 'none'").agg(F.lit("none").alias("category"), (F.coalesce(F.max("p_size"), F.lit(0)) + 1).alias("next_number"), F.count(F.lit(1)).alias("n"))
    return of.unionByName(none)


_SAVES = derived_sql("items", "submitted") + """, s as (select *, count(*) over (partition by run_id, chunk_id) times from submitted), j as (select s.*, i.ord, i.deleted gone, i.decision was, i.label ml, i.type_key mt, i.sub_type ms, i.r_label rl, i.r_type rt, i.r_sub rs,
        case when contains(present, 'label') then nullif(s.label, '') when decision in ('accepted', 'corrected') then r_label else i.label end l, case when contains(present, 'type') then nullif(s.type_key, '') when decision in ('accepted', 'corrected') then r_type else i.type_key end t,
        case when contains(present, 'sub') then nullif(s.sub_type, '') when decision in ('accepted', 'corrected') then r_sub else i.sub_type end u0 from s left join (select * from items qualify count(*) over (partition by run_id, chunk_id) = 1) i on i.run_id = s.run_id and i.chunk_id = s.chunk_id),
    v as (select *, case when l = 'Non-clause' then null else u0 end u from j),
    w as (select *, case when ord is null then 'unknown' when gone then 'skipped' when (l, t, u) is not distinct from (ml, mt, ms) then case when ml is null then 'error' else 'accepted' end when l is null or l not in ('Clause', 'Non-clause') or t is null then 'error' else 'corrected' end verdict from v),
    x as (select *, case when verdict in ('accepted', 'corrected') and was is not distinct from verdict and (l, t, u) is not distinct from (rl, rt, rs) then 'unchanged' else verdict end outcome from w)"""


@query(_SAVES + """ select run_id, count(*) filter (outcome in ('unknown', 'error')) errors, count(*) filter (outcome = 'skipped') skipped, count(*) filter (outcome = 'unchanged') unchanged, case when count(*) filter (outcome in ('unknown', 'error')) = 0 then count(*) filter (outcome = 'accepted') else 0 end accepted,
    case when count(*) filter (outcome in ('unknown', 'error')) = 0 then count(*) filter (outcome = 'corrected') else 0 end corrected from x group by 1""")
def r4_saves(spark, sf_dir):
    """Saves of whole runs: what is accepted, corrected, unchanged and skipped; a single error saves nothing."""
    return review.saved(derived(spark, sf_dir, "items"), derived(spark, sf_dir, "submitted"))[0]


@query(_SAVES + """, ok as (select run_id from x group by 1 having count(*) filter (outcome in ('unknown', 'error')) = 0), c as (select x.run_id, ord, unnest([{'f': 'decision', 'a': was, 'b': outcome}, {'f': 'label', 'a': rl, 'b': l}, {'f': 'type', 'a': rt, 'b': t}, {'f': 'sub_type', 'a': rs, 'b': u}]) z from x join ok using (run_id) where outcome in ('accepted', 'corrected'))
    select run_id, ord, z.f field, z.a "from", z.b "to" from c where z.a is distinct from z.b""")
def r4_change_log(spark, sf_dir):
    """The fields that each saved item changed, from what to what."""
    return review.saved(derived(spark, sf_dir, "items"), derived(spark, sf_dir, "submitted"))[1]
