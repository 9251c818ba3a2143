"""Segments, answers, runs and persisted rows by their exact rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, retrieval
from ..sources.shared import new_path
from ..sources.tables import load
from .derived import derived, derived_sql
from .outlines import _LEX
from .registry import query
from .retrieval import _DENSE, TOP, _vector


@query(_LEX + rf""", s as (select *, case when coalesce(text, '') = '' then 'empty' when heading = 2 then 'toc' when band = 2 and heading is null then 'table' else 'content' end b0 from lex), st as (select doc, min(ord) filter (b0 = 'content' and heading is null and cls is not null) begin from s group by 1),
    f as (select s.*, b0 = 'content' and coalesce(ord < begin, false) front from s join st using (doc)), f2 as (select *, front and coalesce(heading = 0, false) head, trim(coalesce(text, '')) x from f), ti as (select doc, coalesce(trim(string_agg(text, ' ' order by ord) filter (head)), arg_min(text, ord)) title from f2 where front group by 1),
    n as (select *, x = '' or regexp_matches(x, '{lifecycle.NOISE}') or (length(x) <= {lifecycle.NOISE_CHARS} and not regexp_matches(x, '{lifecycle.SUBSTANCE}') and not contains(rtrim(x, '.'), '.')) noise from f2)
    select n.doc, ord, case when not front then b0 when head then 'document_title' when noise then 'intro_removed' else 'content' end bucket, front and not head and not noise front_matter, title from n left join ti on ti.doc = n.doc""")
def p18_buckets(spark, sf_dir):
    """Each line's bucket, and each document's title."""
    rows = derived(spark, sf_dir, "lines")
    return lifecycle.segmented(rows.withColumns({"style": F.when(F.col("heading") == 2, "toc 1"), "kind": F.when((F.col("band") == 2) & F.col("heading").isNull(), "table").otherwise("body")}))


_VOCABULARY = "select unnest(['View', 'Click', 'Signup', 'Error']) as name, unnest(['k_view', 'k_click', 'k_signup', 'k_error']) as key, 'Clause' as applies_to union all select unnest(['Purchase', 'Error']), unnest(['k_purchase', 'n_error']), 'Non-clause'"


@query(derived_sql("model_items") + f""", v as ({_VOCABULARY}), j as (select m.*, v.name, v.key, nullif(trim(regexp_replace(coalesce(reason, ''), '\\s+', ' ', 'g')), '') r, nullif(trim(rtrim(trim(trim(regexp_replace(coalesce(sub_type, ''), '\\s+', ' ', 'g')), '"'''), '.:;,')), '') t
        from model_items m left join v on lower(v.name) = lower(m.canonical_type) and v.applies_to = m.label),
    e as (select *, case when r is null then 'empty reason' when not (label = 'Clause' and canonical_type is null) and key is null then case when label = 'Clause' then 'not a clause type' else 'not a non-clause type' end end error from j)
    select id, case when error is null then case when label = 'Clause' and canonical_type is null then 'unclassified' else 'classified' end end outcome, case when error is null then label end as label, case when error is null then key end type_key, case when error is null and label = 'Clause' then case when length(t) > 255 then rtrim(left(t, 255)) else t end end sub_type, case when error is null then r end reason,
    case when error is null then concat_ws('; ', case when label = 'Clause' and t is null then 'no sub_type given' end, case when label = 'Clause' and length(t) > 255 then 'sub_type truncated' end, case when name <> canonical_type then 'resolved by name' end) end notes, error from e""")
def m19_post_processed(spark, sf_dir):
    """A model's answers after the vocabulary, titles and reasons were seen to (M17)."""
    names = {"Clause": {"View": "k_view", "Click": "k_click", "Signup": "k_signup", "Error": "k_error"}, "Non-clause": {"Purchase": "k_purchase", "Error": "n_error"}}
    vocabulary = spark.createDataFrame([(n, k, a) for a, of in names.items() for n, k in of.items()], "name string, key string, applies_to string")
    return lifecycle.post_processed(derived(spark, sf_dir, "model_items"), vocabulary)


_RUNS = derived_sql("class_runs")


@query(_RUNS + " select document_id, attempt, case when status = 'running' then 'failed' else status end status, case when status = 'running' then 'abandoned' end error from class_runs union all select document_id, max(attempt) + 1, 'running', null from class_runs group by 1")
def m21_started_runs(spark, sf_dir):
    """All runs after a new one was started for each document."""
    return lifecycle.started(derived(spark, sf_dir, "class_runs"))


@query(_RUNS + """, l as (select * from class_runs where status = 'succeeded' qualify row_number() over (partition by document_id order by attempt desc) = 1), d as (select distinct document_id from class_runs)
    select d.document_id, coalesce(taxonomy <> 't2' or prompt <> 'p2' or model <> 'm2' or prompt_hash <> substr(md5('1'), 1, 8), true) stale, coalesce(least_confidence < 70, false) judged from d left join l using (document_id)""")
def m23_stale_runs(spark, sf_dir):
    """Documents whose last finished run was made with another taxonomy, prompt, model or prompt text, and those a judge is asked for (M24)."""
    import hashlib

    return lifecycle.stale(derived(spark, sf_dir, "class_runs"), "t2", "p2", "m2", hashlib.md5(b"1").hexdigest()[:8])


@query(_RUNS + ", t as (select document_id, attempt, unnest([{'s': 'parse', 'ms': parse_ms}, {'s': 'chunk', 'ms': chunk_ms}, {'s': 'classify', 'ms': classify_ms}]) x from class_runs) select document_id, attempt, x.s stage, x.ms ms from t where x.ms is not null union all select document_id, attempt, 'persist', 0 from class_runs")
def k4_stage_logs(spark, sf_dir):
    """A row for each stage that a run timed, and one for its being persisted."""
    runs = derived(spark, sf_dir, "class_runs")
    timed = F.map_filter(F.create_map(*[x for s in ("parse", "chunk", "classify") for x in (F.lit(s), F.col(f"{s}_ms").cast("long"))]), lambda k, v: v.isNotNull())
    return runs.select("document_id", "attempt", F.explode(timed).alias("stage", "ms")).unionByName(runs.select("document_id", "attempt", F.lit("persist").alias("stage"), F.lit(0).cast("long").alias("ms")))


@query(_RUNS + " select status, count(*) runs, sum(parse_ms) parse_ms, coalesce(sum(chunk_ms), 0) chunk_ms, coalesce(sum(classify_ms), 0) classify_ms from class_runs group by 1")
def a15_stage_sums(spark, sf_dir):
    """Time by stage over the runs of each status; a stage that was never timed took 0."""
    sums = [F.coalesce(F.sum(f"{s}_ms"), F.lit(0)).alias(f"{s}_ms") for s in ("parse", "chunk", "classify")]
    return derived(spark, sf_dir, "class_runs").groupBy("status").agg(F.count(F.lit(1)).alias("runs"), *sums)


@query(derived_sql("items") + """, c as (select run_id, ord, chunk_id, case when p3 then 'c' || (ord - 1) when p5 then 'c99' end parent from (select *, length(coalesce(source_text, '')) % 3 = 0 and ord > 1 p3, length(coalesce(source_text, '')) % 5 = 1 p5 from items)), k as (select distinct run_id, chunk_id from items)
    select c.run_id, ord, case when k.chunk_id is not null then parent end parent, case when parent is not null and k.chunk_id is null then 'parent ' || parent || ' is missing' end issue from c left join k on k.run_id = c.run_id and k.chunk_id = c.parent""")
def k2_clause_rows(spark, sf_dir):
    """Rows with the keys of their parents; a parent that the run lacks makes a root, with an issue (K3)."""
    n = F.length(F.coalesce("source_text", F.lit("")))
    parent = F.when((n % 3 == 0) & (F.col("ord") > 1), F.concat(F.lit("c"), F.col("ord") - 1)).when(n % 5 == 1, "c99")
    items = derived(spark, sf_dir, "items").select("run_id", "ord", "chunk_id", parent.alias("parent"))
    known = items.select("run_id", F.col("chunk_id").alias("parent")).distinct().withColumn("there", F.lit(True))
    rows = items.join(known, ["run_id", "parent"], "left")
    lost = F.col("parent").isNotNull() & F.col("there").isNull()
    return rows.select("run_id", "ord", F.when(~lost, F.col("parent")).alias("parent"), F.when(lost, F.concat(F.lit("parent "), "parent", F.lit(" is missing"))).alias("issue"))


@query(derived_sql("asked", "answers") + " select call_id, id from asked a where not exists (select 1 from answers b where b.call_id = a.call_id and b.id = a.id)")
def j7_unanswered(spark, sf_dir):
    """What was asked and has no answer at all."""
    return derived(spark, sf_dir, "asked").join(derived(spark, sf_dir, "answers"), ["call_id", "id"], "left_anti").select("call_id", "id")


@query(derived_sql("items", "paragraphs") + " select run_id, i.ord, case when trim(coalesce(source_text, '')) = '' then p.text else source_text end as text from items i left join paragraphs p on 'r' || p.doc = i.run_id and p.ord = i.ord")
def j12_filled_texts(spark, sf_dir):
    """Items without a text of their own take that of their paragraph (R14)."""
    items = derived(spark, sf_dir, "items").select("run_id", "ord", "source_text")
    texts = derived(spark, sf_dir, "paragraphs").select(F.concat(F.lit("r"), "doc").alias("run_id"), "ord", "text")
    return items.join(texts, ["run_id", "ord"], "left").select("run_id", "ord", F.when(F.trim(F.coalesce("source_text", F.lit(""))) == "", F.col("text")).otherwise(F.col("source_text")).alias("text"))


@query("""with a as (select user_id, event_type, min(event_id) event_id from events where event_type in ('view', 'click') group by 1, 2), b as (select user_id, event_type, min(event_id) event_id from events where event_type in ('click', 'error') group by 1, 2)
    select user_id, event_type, event_id from a union all select * from b where not exists (select 1 from a where a.user_id = b.user_id and a.event_type = b.event_type)""")
def k6_appended_rows(spark, sf_dir):
    """A table after two appends that overlap, each run twice: rows that are there stay as they are."""
    path, events = new_path(spark, "rows"), load(spark, sf_dir, "events", "user_id", "event_type", "event_id")
    for kinds in (("view", "click"), ("view", "click"), ("click", "error"), ("click", "error")):
        lifecycle.append_absent(path, events.filter(F.col("event_type").isin(*kinds)), ["user_id", "event_type"])
    return spark.read.schema(events.schema).parquet(path)


@query("""with f as (select r_regionkey version, n_name as key from nation join region on n_regionkey = r_regionkey), h as (select n_regionkey version, case when n_regionkey = 2 and n_nationkey % 2 = 0 then n_name || '!' else n_name end as key from nation where n_regionkey not in (1)), d as (select version, key from f except select version, key from h), e as (select version, key from h except select version, key from f)
    select r_regionkey version, case when not exists (select 1 from h where h.version = r_regionkey) then 'seeded' when exists (select 1 from d where d.version = r_regionkey) or exists (select 1 from e where e.version = r_regionkey) then 'refused' else 'unchanged' end outcome, (select count(*) from d where d.version = r_regionkey) missing, (select count(*) from e where e.version = r_regionkey) unknown from region""")
def k13_seeds(spark, sf_dir):
    """Seeding of vocabularies: a version that is not there is put in, one with the same keys stays, one with others is refused (U7)."""
    nation = load(spark, sf_dir, "nation", "n_regionkey", "n_name", "n_nationkey")
    file = nation.select(F.col("n_regionkey").alias("version"), F.col("n_name").alias("key"))
    changed = (F.col("n_regionkey") == 2) & (F.col("n_nationkey") % 2 == 0)
    held = nation.filter("n_regionkey <> 1").select(F.col("n_regionkey").alias("version"), F.when(changed, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("key"))
    both = file.distinct().withColumn("f", F.lit(True)).join(held.distinct().withColumn("h", F.lit(True)), ["version", "key"], "full_outer")
    of = both.groupBy("version").agg(F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("f").isNull()).alias("unknown"), F.count("h").alias("held"))
    outcome = F.when(F.col("held") == 0, "seeded").when((F.col("missing") > 0) | (F.col("unknown") > 0), "refused").otherwise("unchanged")
    return load(spark, sf_dir, "region", F.col("r_regionkey").alias("version")).join(of, "version", "left").select("version", outcome.alias("outcome"), F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("unknown", F.lit(0)).alias("unknown"))


@query(f"with {_DENSE} select id, label, round(score, 6) score from dn where label in (1, 3, 4) order by round(score, 9) desc, id limit {2 * TOP}")
def f5_filtered_top_k(spark, sf_dir):
    """Nearest vectors among those that pass a filter, which is applied below the top list (V2); `All` filters nothing."""
    wanted = {"label": [1, 3, 4], "kind": "All"}
    rows = load(spark, sf_dir, "embeddings")
    for column, values in wanted.items():
        rows = rows if values == "All" else rows.filter(F.col(column).isin(values))
    best = retrieval.top(retrieval.dense(rows, _vector(spark, sf_dir), "vec_id", "embedding"), 2 * TOP)
    return best.join(rows.select(F.col("vec_id").alias("id"), "label"), "id").select("id", "label", F.round("score", 6).alias("score"))


@query(derived_sql("listed", "class_runs") + """, cur as (select * from class_runs qualify row_number() over (partition by document_id order by attempt desc) = 1), fin as (select * from class_runs where status = 'succeeded' qualify row_number() over (partition by document_id order by attempt desc) = 1), n as (select document_id, count(*) runs, count(*) filter (status = 'failed') failed from class_runs group by 1),
    d as (select cast(substr(folder, 2) as bigint) document_id, count(*) documents, count(distinct reviewer) reviewers from listed where not deleted group by 1)
    select c.c_custkey document_id, cur.attempt as latest, cur.status latest_status, fin.attempt as finished, fin.taxonomy, coalesce(n.runs, 0) runs, coalesce(n.failed, 0) failed, d.documents, d.reviewers from customer c left join cur on cur.document_id = c_custkey left join fin on fin.document_id = c_custkey left join n on n.document_id = c_custkey left join d on d.document_id = c_custkey""")
def j4_document_rows(spark, sf_dir):
    """Documents with their latest run, last finished run, counts and reviewers; what did not happen is null (F17, J3). One aggregate gives all that runs tell."""
    runs = derived(spark, sf_dir, "class_runs")
    done = F.col("status") == "succeeded"
    of = runs.groupBy("document_id").agg(F.max_by(F.struct("attempt", "status"), "attempt").alias("l"), F.max_by(F.when(done, F.struct("attempt", "taxonomy")), F.when(done, F.col("attempt"))).alias("f"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"))
    folders = derived(spark, sf_dir, "listed").filter(~F.col("deleted")).groupBy(F.substring("folder", 2, 20).cast("long").alias("document_id")).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("reviewer").alias("reviewers"))
    docs = load(spark, sf_dir, "customer", F.col("c_custkey").alias("document_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.join(of, "document_id", "left").join(folders, "document_id", "left").select("document_id", F.col("l.attempt").alias("latest"), F.col("l.status").alias("latest_status"), F.col("f.attempt").alias("finished"), F.col("f.taxonomy").alias("taxonomy"), zero("runs"), zero("failed"), "documents", "reviewers")


_BROKEN = {
    "one current run": "select 'one current run' as rule, cast(document_id as string) as place from class_runs where is_current group by document_id having count(*) > 1",
    "current is finished": "select 'current is finished', document_id || '/' || attempt from class_runs where is_current and status <> 'succeeded'",
    "order unique": "select 'order unique', run_id || '/' || chunk_id from items group by run_id, chunk_id having count(*) > 1",
    "external id unique": "select 'external id unique', lower(trim(name)) from listed where name is not null group by lower(trim(name)) having count(*) > 1",
    "document of its run": "select 'document of its run', run_id || '/' || ord from items where document_id <> 'd' || substr(run_id, 2)",
}


@query(derived_sql("class_runs", "items", "listed") + " " + " union all ".join(_BROKEN.values()))
def x_run_violations(spark, sf_dir):
    """Runs, items and documents that break a constraint of uniqueness, of state or of belonging."""
    frames = {n: derived(spark, sf_dir, n) for n in ("class_runs", "items", "listed")}
    text = " union all ".join(_BROKEN.values())
    for n in frames:
        text = text.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(text, **frames)
