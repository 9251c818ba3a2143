"""Reviews, runs and publishing by their exact rules, on rows derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import review
from .derived import derived, derived_sql
from .registry import query

_ITEMS = derived_sql("items")
_TEXT = "coalesce(edited, source_text)"
_KEY = ["run_id", "chunk_id", "ord"]


@query(_ITEMS + """, e as (select *, string_split(expected, '|') x from items)
    select run_id, chunk_id, ord, concat_ws(',', case when outcome in ('failed', 'unclassified') then outcome end, case when confidence < 0.85 then 'low_confidence' end, case when type_key in ('liability', 'indemnity') then 'high_risk' end,
        case when outcome = 'classified' and label = 'Clause' and expected <> '' and not coalesce(list_contains(x, type_key), false) then 'deviated' end) reasons from e""")
def m20_routing(spark, sf_dir):
    """Reasons for review, in fixed order."""
    return review.routed(derived(spark, sf_dir, "items")).select(*_KEY, F.array_join("reasons", ",").alias("reasons"))


@query(derived_sql("items", "submitted") + """, j as (select s.sid, i.label ml, i.type_key mt, i.sub_type ms,
        case when contains(present, 'label') then nullif(s.label, '') when decision in ('accepted', 'corrected') then r_label else i.label end l,
        case when contains(present, 'type') then nullif(s.type_key, '') when decision in ('accepted', 'corrected') then r_type else i.type_key end t,
        case when contains(present, 'sub') then nullif(s.sub_type, '') when decision in ('accepted', 'corrected') then r_sub else i.sub_type end u
        from submitted s join items i using (run_id, chunk_id)), v as (select *, case when l = 'Non-clause' then null else u end w from j)
    select sid, l as label, t as type_key, w as sub_type, case when (l, t, w) is not distinct from (ml, mt, ms) then case when ml is null then 'error: no model label' else 'accepted' end
        when l is null or l not in ('Clause', 'Non-clause') then 'error: label' when t is null then 'error: type' else 'corrected' end verdict from v""")
def r3_decisions(spark, sf_dir):
    """Verdicts on submissions against the model's triple."""
    return review.decided(derived(spark, sf_dir, "items"), derived(spark, sf_dir, "submitted"))


@query(_ITEMS + f"""select document_id, count(*) filter (not deleted and decision is null and flagged) needs_review,
    count(*) filter (not deleted and ((decision is null and not flagged and (label is null or label = 'Clause' and type_key is null)) or (decision in ('accepted', 'corrected') and r_label = 'Clause' and r_type is null))) missing_type,
    count(*) filter (not deleted and regexp_matches(coalesce({_TEXT}, ''), '^\\s*$')) empty_text, count(*) filter (not deleted and decision = 'rejected') rejected, bool_and(deleted) all_deleted from items group by 1""")
def f9_publish_blockers(spark, sf_dir):
    """Counts of what blocks publishing, a document."""
    return review.readiness(derived(spark, sf_dir, "items"))


@query(_ITEMS + f"select run_id, chunk_id, ord, {_TEXT} as text from items")
def f16_current_text(spark, sf_dir):
    """The edit, else the source."""
    return derived(spark, sf_dir, "items").select(*_KEY, review.current_text().alias("text"))


@query(_ITEMS + "select run_id, chunk_id, ord from items where flagged and decision is null and not deleted")
def f8_live_needs_review(spark, sf_dir):
    """Flagged, undecided and live items."""
    return derived(spark, sf_dir, "items").filter("flagged and decision is null and not deleted").select(*_KEY)


@query(_ITEMS + f""", g as (select run_id, ord, coalesce(regexp_replace({_TEXT}, '\\s+$', ''), '') x, (select min(t.ord) from items t where t.run_id = i.run_id and t.ord > i.ord and not t.deleted) target from items i where decision = 'rejected' and not deleted and not exists (select 1 from items b where b.run_id = i.run_id and b.ord < i.ord and b.decision = 'rejected' and not b.deleted))
    select i.run_id, i.ord, case when t.x is not null then t.x || chr(10) || coalesce({_TEXT}, '') else {_TEXT} end as text, i.deleted or g.ord is not null as deleted, case when g.ord is not null then g.target end merged_into
    from items i left join g on g.run_id = i.run_id and g.ord = i.ord left join g t on t.run_id = i.run_id and t.target = i.ord""")
def r6_delete_and_merge(spark, sf_dir):
    """The first live item of a run that a reviewer rejected is deleted into the next live item."""
    items = derived(spark, sf_dir, "items")
    first = items.filter("decision = 'rejected' and not deleted").groupBy("run_id").agg(F.min("ord").alias("ord"))
    return review.deleted_into_next(items, first)


@query(_ITEMS + f""", m as (select g.run_id, g.ord, g.merged_into target, not t.deleted live, coalesce(t.edited, t.source_text) x, regexp_replace(coalesce(nullif(g.edited, ''), g.source_text), '\\s+$', '') || chr(10) p from items g join items t on g.run_id = t.run_id and g.merged_into = t.chunk_id where g.deleted)
    select run_id, ord, target, live and starts_with(x, p) and length(x) > length(p) unmerged, case when live and starts_with(x, p) and length(x) > length(p) then substr(x, length(p) + 1) else x end target_text from m""")
def r7_restore(spark, sf_dir):
    """Merged items and what their restoring leaves in the target."""
    return review.restored(derived(spark, sf_dir, "items"))


@query(derived_sql("records") + """, a as (select *, case when deleted and (synced_at is not null or vector_id is not null) then 'remove' when not deleted and (is_modified or synced_at is null) then 'publish' end as action,
    bool_or(not deleted and not is_modified and synced_at is not null) over (partition by document_id) differential from records) select document_id, paragraph_id, action, differential from a where action is not null""")
def r10_publish_plan(spark, sf_dir):
    """What a publish embeds and removes, and whether it is differential."""
    return review.publish_plan(derived(spark, sf_dir, "records"))


@query(derived_sql("records") + "select document_id, paragraph_id from records r where not deleted")
def j22_publish_set(spark, sf_dir):
    """Records without the deleted ones, by anti-join."""
    rows = derived(spark, sf_dir, "records")
    return rows.join(rows.filter("deleted").select("document_id", "paragraph_id"), ["document_id", "paragraph_id"], "left_anti").select("document_id", "paragraph_id")


@query(derived_sql("known_files", "seen_files", "walked") + """, d as (select s.*, k.document_id, k.name kn, k.folder kf, k.mtime km, k.deleted from seen_files s left join known_files k using (file_id)),
    x as (select document_id, case when deleted then 'restored' when name is distinct from kn then 'renamed' when mtime is distinct from km then 'updated' when folder is distinct from kf then 'moved' else 'unchanged' end bucket from d where document_id is not null),
    f as (select name, folder, min(document_id) document_id from known_files where not deleted and document_id not in (select document_id from x) group by 1, 2),
    y as (select distinct coalesce(f.document_id, d.file_id) document_id, case when f.document_id is null then 'created' else 'updated' end bucket from d left join f on f.name is not distinct from d.name and f.folder is not distinct from d.folder where d.document_id is null),
    z as (select document_id, case when folder is null or folder in (select folder from walked union select folder from seen_files) then 'deleted' else 'out_of_scope' end bucket from known_files where not deleted and document_id not in (select document_id from x union select document_id from y))
    select * from x union all select * from y union all select * from z""")
def r1_snapshot_buckets(spark, sf_dir):
    """A folder snapshot against the known documents."""
    return review.reconciled(*(derived(spark, sf_dir, n) for n in ("known_files", "seen_files", "walked")))


@query(_ITEMS + """, s as (select document_id, bool_and(decision is not null) filter (not deleted) all_reviewed, min(case when ord % 5 = 0 then 'published' when ord % 5 = 1 then 'reopened_in_review' when ord % 5 = 2 then 'reviewed' else 'pending' end) now from items group by 1)
    select document_id, now, (case when now = 'published' or starts_with(now, 'reopened') then 'reopened_' else '' end) || (case when coalesce(all_reviewed, true) then 'reviewed' else 'in_review' end) then_ from s""")
def r8_status_machine(spark, sf_dir):
    """A document's status after a save: by whether all live items are decided, and whether it was published before."""
    kind = F.col("ord") % 5
    now = F.when(kind == 0, "published").when(kind == 1, "reopened_in_review").when(kind == 2, "reviewed").otherwise("pending")
    docs = derived(spark, sf_dir, "items").groupBy("document_id").agg(F.min(now).alias("now"), F.count_if(F.expr("not deleted and decision is null")).alias("open"))
    return docs.select("document_id", "now", review.next_status(F.col("now"), F.col("open") == 0).alias("then_"))


_RUNS = derived_sql("runs")
_LATEST = ", u as (select *, row_number() over (partition by document_id order by attempt desc) n from runs where status = 'succeeded'), c as (select distinct r.document_id, r.deleted, r.seen_mtime from runs r where attempt = (select max(attempt) from runs x where x.document_id = r.document_id))"


@query(_RUNS + _LATEST + """ select c.document_id, case when c.deleted then false when u.document_id is null then true when u.build <> 'b2' or u.schema_v <> 3 then true when u.mtime is not null and c.seen_mtime is not null then c.seen_mtime > u.mtime else false end pending
    from c left join u on c.document_id = u.document_id and u.n = 1""")
def f19_pending_extraction(spark, sf_dir):
    """Documents to parse again: by their last usable run's build, schema and source time."""
    runs = derived(spark, sf_dir, "runs")
    last = runs.groupBy("document_id").agg(F.max_by(F.struct("deleted", "seen_mtime"), "attempt").alias("d"), F.max_by(F.when(F.col("status") == "succeeded", F.struct("build", "schema_v", "mtime")), F.when(F.col("status") == "succeeded", F.col("attempt"))).alias("u"))
    times = F.col("u.mtime").isNotNull() & F.col("d.seen_mtime").isNotNull()
    pending = F.when(F.col("d.deleted"), False).when(F.col("u").isNull(), True).when((F.col("u.build") != "b2") | (F.col("u.schema_v") != 3), True).when(times, F.col("d.seen_mtime") > F.col("u.mtime")).otherwise(False)
    return last.select("document_id", pending.alias("pending"))


@query(_RUNS + "select document_id, attempt, case when rows_n < micro then 'failed' when micro > 0 and failed_n = micro then 'failed' when failed_n > 0 then 'succeeded, with warnings' else 'succeeded' end final from runs")
def m22_final_status(spark, sf_dir):
    """A run's status from its chunks, rows and failures."""
    final = F.when(F.col("rows_n") < F.col("micro"), "failed").when((F.col("micro") > 0) & (F.col("failed_n") == F.col("micro")), "failed").when(F.col("failed_n") > 0, "succeeded, with warnings").otherwise("succeeded")
    return derived(spark, sf_dir, "runs").select("document_id", "attempt", final.alias("final"))


@query(_RUNS + "select document_id, attempt from runs where rows_n < micro")
def f10_unfinished_runs(spark, sf_dir):
    """Runs with fewer rows than chunks."""
    return derived(spark, sf_dir, "runs").filter("rows_n < micro").select("document_id", "attempt")


@query(_RUNS + "select document_id, bool_or(status = 'succeeded' and coalesce(hash, '') <> '' and hash = 'h1' and schema_v = 3 and build = 'b2') skip from runs group by 1")
def k1_skip_same_parse(spark, sf_dir):
    """Documents for which a parse with hash h1 is already there: usable, with equal hash, schema and build."""
    same = (F.col("status") == "succeeded") & (F.coalesce("hash", F.lit("")) != "") & (F.col("hash") == "h1") & (F.col("schema_v") == 3) & (F.col("build") == "b2")
    return derived(spark, sf_dir, "runs").groupBy("document_id").agg(F.bool_or(F.coalesce(same, F.lit(False))).alias("skip"))


@query(_ITEMS + "select run_id, coalesce(type_key, '-') type_key, count(*) n from items group by all")
def a3_type_histogram(spark, sf_dir):
    """Items of each type, a run."""
    return derived(spark, sf_dir, "items").groupBy("run_id", F.coalesce("type_key", F.lit("-")).alias("type_key")).agg(F.count("*").alias("n"))


@query(_ITEMS + "select run_id, count(*) filter (flagged and decision is null and not deleted) n from items group by 1")
def a6_live_review_count(spark, sf_dir):
    """Items that still wait for review, a run."""
    return derived(spark, sf_dir, "items").groupBy("run_id").agg(F.count_if(F.expr("flagged and decision is null and not deleted")).alias("n"))


@query(_ITEMS + ", c as (select run_id, count(*) filter (decision is not null and not deleted) reviewed, count(*) filter (deleted) gone, count(*) total from items group by 1) select run_id, reviewed, total - gone as live, greatest(total - gone - reviewed, 0) pending from c")
def a5_reviewed_and_pending(spark, sf_dir):
    """Live decisions and what is left, a run."""
    rows = derived(spark, sf_dir, "items").groupBy("run_id").agg(F.count_if(F.expr("decision is not null and not deleted")).alias("reviewed"), F.count_if(F.expr("not deleted")).alias("live"))
    return rows.withColumn("pending", F.greatest(F.col("live") - F.col("reviewed"), F.lit(0)))


@query(_ITEMS + "select coalesce(label, '-') as label, outcome, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 1) pct from items group by all")
def a16_label_outcome_split(spark, sf_dir):
    """Items by label and outcome, with their share."""
    rows = derived(spark, sf_dir, "items").groupBy(F.coalesce("label", F.lit("-")).alias("label"), "outcome").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("all"))
    return rows.join(F.broadcast(total), F.lit(True)).select("label", "outcome", "n", F.round(100.0 * F.col("n") / F.col("all"), 1).alias("pct"))


@query(_ITEMS + ", k as (select outcome as kind, ord, run_id from items union all select label || ': ' || type_key, ord, run_id from items where type_key is not null and label is not null union all select decision, ord, run_id from items where decision is not null) select kind, count(*) n, cast(row_number() over (order by count(*) desc, min((run_id, ord)), kind) as integer) place from k group by 1")
def a17_export_counters(spark, sf_dir):
    """Counts by outcome, label with type, and decision; most common first, then first seen."""
    kinds = F.array_compact(F.array("outcome", F.concat("label", F.lit(": "), "type_key"), "decision"))
    rows = derived(spark, sf_dir, "items").select(F.explode(kinds).alias("kind"), F.struct("run_id", "ord").alias("seen"))
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))  # as few as there are kinds
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "seen", "kind"))).select("kind", "n", "place")


_RULES = {
    "type iff classified": "(outcome = 'classified') <> (type_key is not null)",
    "unclassified is Clause": "outcome = 'unclassified' and coalesce(label, '') <> 'Clause'",
    "failed has no answer": "outcome = 'failed' and (label is not null or confidence is not null) or outcome <> 'failed' and (label is null or confidence is null)",
    "Non-clause has no sub_type": "label = 'Non-clause' and sub_type is not null or r_label = 'Non-clause' and r_sub is not null",
    "confidence in 0 to 1": "confidence < 0 or confidence > 1",
    "corrected has type": "decision = 'corrected' and r_type is null",
    "rejected has note": "decision = 'rejected' and coalesce(note, '') = ''",
}


@query(_ITEMS + ", v as (" + " union all ".join(f"select '{name}' rule, run_id || '/' || ord place from items where {test}" for name, test in _RULES.items()) + """ union all select 'one row per chunk', run_id || '/' || chunk_id from items group by run_id, chunk_id having count(*) > 1
    union all select 'one document per run', run_id from items group by run_id having count(distinct document_id) > 1) select rule, place from v""")
def x_item_violations(spark, sf_dir):
    """Items that break a constraint."""
    items = derived(spark, sf_dir, "items")
    broken = F.array_compact(F.array(*[F.when(F.expr(test), name) for name, test in _RULES.items()]))
    rows = items.select(F.explode(broken).alias("rule"), F.concat_ws("/", "run_id", "ord").alias("place"))
    chunks = items.groupBy("run_id", "chunk_id").count().filter("count > 1").select(F.lit("one row per chunk"), F.concat_ws("/", "run_id", "chunk_id"))
    runs = items.groupBy("run_id").agg(F.count_distinct("document_id").alias("n")).filter("n > 1").select(F.lit("one document per run"), "run_id")
    return rows.union(chunks).union(runs)


@query(derived_sql("asked", "answers") + """, n as (select call_id, id, count(*) n, any_value(reason) reason, any_value(confidence) c, any_value(type_key) t, any_value(sub_type) s, any_value(label) l from answers group by 1, 2),
    j as (select a.call_id, a.id, case when n is null then 'missing' when n > 1 then 'duplicate' when coalesce(trim(reason), '') = '' then 'empty reason' when c < 0 or c > 1 then 'confidence' else 'ok' end problem from asked a left join n using (call_id, id))
    select j.call_id, j.id, problem, exists (select 1 from answers b where b.call_id = j.call_id and b.id not in (select id from asked q where q.call_id = j.call_id)) unknown_ids from j""")
def m18_validated_answers(spark, sf_dir):
    """Each asked paragraph's answer: ok, or its problem. A second answer undoes the first; unknown ids mark the call."""
    asked, answers = derived(spark, sf_dir, "asked"), derived(spark, sf_dir, "answers")
    each = answers.groupBy("call_id", "id").agg(F.count("*").alias("n"), F.max_by("reason", "reason").alias("reason"), F.max("confidence").alias("c"))
    unknown = answers.join(asked, ["call_id", "id"], "left_anti").select("call_id").distinct().withColumn("u", F.lit(True))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "empty reason").when(~F.col("c").between(0, 1), "confidence").otherwise("ok")
    return asked.join(each, ["call_id", "id"], "left").join(unknown, "call_id", "left").select("call_id", "id", problem.alias("problem"), F.coalesce("u", F.lit(False)).alias("unknown_ids"))
