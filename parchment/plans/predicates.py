"""Filters and projections of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from .registry import query


@query("select doc_id, source, n_chars from documents where source = 'src1' and lang in ('en', 'de') and contains(lower(text), lower('The')) order by n_chars desc, doc_id limit 50 offset 5")
def f1_document_list(spark, sf_dir):
    """A page of a filtered list, longest first; the search text is literal."""
    rows = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    found = rows.filter((F.col("source") == "src1") & F.col("lang").isin("en", "de") & F.contains(F.lower("text"), F.lower(F.lit("The"))))
    return found.orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(50).select("doc_id", "source", "n_chars")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def f2_classified(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id").join(load(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")


@query("select event_id, ts, user_id, event_type from events where event_type in ('click', 'error') and user_id = 7 order by ts desc, event_id limit 200")
def f4_activity_feed(spark, sf_dir):
    rows = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return rows.filter(F.col("event_type").isin("click", "error") & (F.col("user_id") == 7)).orderBy(F.desc("ts"), "event_id").limit(200)


@query("select doc_id from documents where not (source is not distinct from 'src1' and lang is not distinct from 'en')")
def f11_null_safe_exclude(spark, sf_dir):
    rows = load(spark, sf_dir, "documents", "doc_id", "source", "lang")
    return rows.filter(~(F.col("source").eqNullSafe("src1") & F.col("lang").eqNullSafe("en"))).select("doc_id")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events where json_extract_string(props, '$.k') = '69' or value > 200")
def f13_json_projection(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return load(spark, sf_dir, "events", "event_id", "props", "value").filter((k == "69") | (F.col("value") > 200)).select("event_id", k.try_cast("bigint").alias("k"))


@query("""select doc_id, case when toxic = 1 then null when quality is not null then 'reviewed' else 'model' end verdict, case when toxic = 1 then null else lang end label
    from documents left join labels using (doc_id)""")
def f15_current_verdict(spark, sf_dir):
    """The reviewer's verdict where there is one (none when rejected), else the model's."""
    rows = load(spark, sf_dir, "documents", "doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    rejected = F.col("toxic") == 1
    return rows.select("doc_id", F.when(rejected, None).when(F.col("quality").isNotNull(), "reviewed").otherwise("model").alias("verdict"), F.when(rejected, None).otherwise(F.col("lang")).alias("label"))


@query("select count(*) filter (n_chars < 500) short, count(*) filter (n_chars between 500 and 5000) medium, count(*) filter (n_chars > 5000) long, count(*) filter (toxic = 1) rejected, count(*) filter (quality is null) open from documents left join labels using (doc_id)")
def f26_tab_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "documents", "doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    return rows.agg(F.count_if(n < 500).alias("short"), F.count_if(n.between(500, 5000)).alias("medium"), F.count_if(n > 5000).alias("long"), F.count_if(F.col("toxic") == 1).alias("rejected"), F.count_if(F.col("quality").isNull()).alias("open"))


@query("select p_partkey from part where list_has_any([contains(lower(p_type), s) or contains(s, lower(p_type)) for s in ['brass', 'small plated tin']], [true])")
def f27_either_way_match(spark, sf_dir):
    kind = F.lower("p_type")
    hits = [F.contains(kind, F.lit(s)) | F.contains(F.lit(s), kind) for s in ("brass", "small plated tin")]
    return load(spark, sf_dir, "part", "p_partkey", "p_type").filter(hits[0] | hits[1]).select("p_partkey")


@query("select c_custkey from customer where contains(lower(c_name), '12') or contains(lower(c_mktsegment), 'build')")
def f28_any_field_search(spark, sf_dir):
    rows = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return rows.filter(F.contains(F.lower("c_name"), F.lit("12")) | F.contains(F.lower("c_mktsegment"), F.lit("build"))).select("c_custkey")


@query("select conv_id, count(*) filter (role = 'assistant') reviewed, count(*) total, bool_and(length(text) > 0) every_saved from conversations group by 1")
def f33_review_counters(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations", "conv_id", "role", "text")
    return rows.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("reviewed"), F.count("*").alias("total"), F.every(F.length("text") > 0).alias("every_saved"))


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1) or (n_chars < 300 and lang = 'en')")
def f12_or_of_sets(spark, sf_dir):
    rows = load(spark, sf_dir, "documents", "doc_id", "n_chars", "lang")
    toxic = load(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return rows.join(toxic, "doc_id", "left").filter(F.col("hit").isNotNull() | ((F.col("n_chars") < 300) & (F.col("lang") == "en"))).select("doc_id")
