"""Counts, histograms and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from .registry import query


@query("""select count(*) total, count(*) filter (quality = 1) classified, count(*) filter (quality = 0) unclassified, count(*) filter (toxic = 1) review,
    count(*) filter (quality = 1 and toxic = 1) both_flags from labels""")
def a1_filtered_counts(spark, sf_dir):
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    return load(spark, sf_dir, "labels", "quality", "toxic").agg(
        F.count("*").alias("total"), F.count_if(good).alias("classified"), F.count_if(F.col("quality") == 0).alias("unclassified"), F.count_if(bad).alias("review"), F.count_if(good & bad).alias("both_flags")
    )


@query("select l_orderkey, cast(coalesce(sum(cast(l_quantity as bigint)), 0) as bigint) total, count(*) calls from lineitem group by 1")
def a2_token_sums(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
    return rows.groupBy("l_orderkey").agg(F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("total"), F.count("*").alias("calls"))


@query("""select reason, count(*) n from (select unnest(list_filter([case when n_chars < 200 then 'short' end, case when toxic = 1 then 'high_risk' end, case when quality = 0 then 'low_confidence' end], lambda x: x is not null)) reason
    from documents left join labels using (doc_id)) group by 1""")
def a4_reason_histogram(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("toxic") == 1, "high_risk"), F.when(F.col("quality") == 0, "low_confidence")))
    return docs.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""select user_id, count(*) filter (event_type = 'click') click, count(*) filter (event_type = 'error') error, count(*) filter (event_type = 'purchase') purchase from events group by 1""")
def a5_decision_counts(spark, sf_dir):
    kinds = ["click", "error", "purchase"]
    return load(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


@query("select o, string_agg(cast(k as varchar), ',' order by k) reviewers from (select distinct l_orderkey o, unnest([l_partkey, l_suppkey]) k from lineitem) group by 1")
def a7_reviewers_of_runs(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").select(F.col("l_orderkey").alias("o"), F.explode(F.array("l_partkey", "l_suppkey")).alias("k"))
    return rows.groupBy("o").agg(F.array_join(F.sort_array(F.collect_set("k")).cast("array<string>"), ",").alias("reviewers"))


@query("select event_type, round(avg(value), 3) mean, count(*) filter (value < 50) low from events group by 1")
def a11_mean_confidence(spark, sf_dir):
    return load(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("mean"), F.count_if(F.col("value") < 50).alias("low"))


@query("select o_orderstatus status, count(*) n from orders group by 1")
def a12_status_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders", "o_orderstatus").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("select cast(ts as date) as day, count(*) n from events group by 1")
def a13_activity_calendar(spark, sf_dir):
    return load(spark, sf_dir, "events", "ts").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("select user_id, count(*) n from events where event_type in ('click', 'purchase') and user_id is not null group by 1")
def a14_contributors(spark, sf_dir):
    rows = load(spark, sf_dir, "events", "user_id", "event_type").filter(F.col("event_type").isin("click", "purchase") & F.col("user_id").isNotNull())
    return rows.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id")


@query("""select coalesce(source, 'Unspecified') source, coalesce(lang, 'Unspecified') lang, count(*) n from documents
    group by rollup (coalesce(source, 'Unspecified'), coalesce(lang, 'Unspecified'))""".replace("coalesce(source, 'Unspecified') source, coalesce(lang, 'Unspecified') lang", "coalesce(source, 'Unspecified') s, coalesce(lang, 'Unspecified') l"))
def a18_rollup(spark, sf_dir):
    rows = load(spark, sf_dir, "documents", "source", "lang").select(F.coalesce("source", F.lit("Unspecified")).alias("s"), F.coalesce("lang", F.lit("Unspecified")).alias("l"))
    return rows.rollup("s", "l").agg(F.count("*").alias("n"))


@query("select coalesce(lang, 'Unspecified') l, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 1) pct from documents group by 1")
def a18_distribution(spark, sf_dir):
    rows = load(spark, sf_dir, "documents", "lang")
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.groupBy(F.coalesce("lang", F.lit("Unspecified")).alias("l")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("l", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query("select lang, count(*) n, count(distinct source) sources from documents group by 1")
def a19_coverage(spark, sf_dir):
    return load(spark, sf_dir, "documents", "lang", "source").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("select count(*) n from (select distinct l_partkey, l_suppkey from lineitem)")
def a25_distinct_count(spark, sf_dir):
    return load(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("n"))


@query("select source, max(n_chars) longest, coalesce(max(n_chars) filter (lang = 'de'), 0) longest_de, coalesce(max(doc_id), 0) + 1 next_id from documents group by 1")
def a24_maxima(spark, sf_dir):
    rows = load(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    german = F.max(F.when(F.col("lang") == "de", F.col("n_chars")))
    return rows.groupBy("source").agg(F.max("n_chars").alias("longest"), F.coalesce(german, F.lit(0)).alias("longest_de"), (F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_id"))


@query("select p_type, count(*) n from part group by 1 order by n desc, p_type limit 8")
def o7_most_common(spark, sf_dir):
    return load(spark, sf_dir, "part", "p_type").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(8)


@query("""select p.phase, count(e.event_id) n, max(e.ts) latest from (select unnest(['view', 'click', 'signup', 'purchase', 'refund']) phase) p left join events e on e.event_type = p.phase group by 1""")
def r15_phase_timeline(spark, sf_dir):
    """Every phase of a fixed list, those without events included."""
    phases = spark.sql("select explode(array('view', 'click', 'signup', 'purchase', 'refund')) as phase")
    per = load(spark, sf_dir, "events", "event_id", "event_type", "ts").groupBy(F.col("event_type").alias("phase")).agg(F.count("event_id").alias("n"), F.max("ts").alias("latest"))
    return F.broadcast(phases).join(per, "phase", "left").select("phase", F.coalesce("n", F.lit(0)).alias("n"), "latest")


@query("""select 'orders without lines' stage, count(*) n from orders where o_orderkey not in (select l_orderkey from lineitem)
    union all select 'customers without orders', count(*) from customer where c_custkey not in (select o_custkey from orders)
    union all select 'documents without labels', count(*) from documents where doc_id not in (select doc_id from labels)""")
def r16_gap_report(spark, sf_dir):
    gap = lambda name, rows: rows.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
    orders, lines, customers = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), load(spark, sf_dir, "lineitem", "l_orderkey"), load(spark, sf_dir, "customer", "c_custkey")
    return (
        gap("orders without lines", orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti"))
        .unionByName(gap("customers without orders", customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti")))
        .unionByName(gap("documents without labels", load(spark, sf_dir, "documents", "doc_id").join(load(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")))
    )
