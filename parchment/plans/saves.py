"""Saves, deletes, refreshes and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.refresh import refresh, validate_save
from ..sources.shared import new_path
from ..sources.tables import load
from .registry import query


@query("""with o as (select doc_id id, md5(text) source, case when doc_id % 5 = 0 then 'edited' else md5(text) end body, lang label, doc_id % 3 = 0 reviewed from documents where doc_id % 10 <> 3),
    n as (select doc_id id, case when doc_id % 4 = 0 then 'new' else md5(text) end source, case when doc_id % 6 = 0 then 'xx' else lang end label from documents where doc_id % 10 <> 4)
    select n.id, case when o.id is null or o.body is not distinct from o.source then n.source else o.body end body, case when o.reviewed then o.label else n.label end label, coalesce(o.reviewed, false) reviewed,
        (case when o.id is null or o.body is not distinct from o.source then n.source else o.body end) is distinct from n.source or (case when o.reviewed then o.label else n.label end) is distinct from n.label modified
    from n left join o on n.id = o.id""")
def k7_refresh(spark, sf_dir):
    """Review rows refreshed from a new run; edits stay, rows that the run lacks go."""
    rows, i = load(spark, sf_dir, "documents", "doc_id", "text", "lang"), F.col("doc_id")
    whole = F.md5("text")
    old = rows.filter(i % 10 != 3).select(i.alias("id"), whole.alias("source"), F.when(i % 5 == 0, "edited").otherwise(whole).alias("body"), F.col("lang").alias("label"), (i % 3 == 0).alias("reviewed"))
    new = rows.filter(i % 10 != 4).select(i.alias("id"), F.when(i % 4 == 0, "new").otherwise(whole).alias("source"), F.when(i % 6 == 0, "xx").otherwise(F.col("lang")).alias("label"))
    return refresh(old, new)


@query("""select doc_id, regexp_replace(substr(coalesce(source, ''), 1, 40), '[^A-Za-z0-9._-]+', '_', 'g') || '__' || substr(md5(cast(doc_id as varchar)), 1, 8) path,
    '{"doc_id":' || doc_id || ',"source":"' || coalesce(source, '') || '","n_chars":' || coalesce(n_chars, 0) || '}' body from documents""")
def k9_exports(spark, sf_dir):
    """JSON exports written to the shared folder, one row a document, and read back."""
    rows = load(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    name = F.regexp_replace(F.substring(F.coalesce("source", F.lit("")), 1, 40), "[^A-Za-z0-9._-]+", "_")
    body = F.to_json(F.struct("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("n_chars")))
    path = new_path(spark, "exports")
    rows.select("doc_id", F.concat(name, F.lit("__"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)).alias("path"), body.alias("body")).write.json(path)
    return spark.read.schema("doc_id long, path string, body string").json(path)


@query("select count(*) filter (l.doc_id is null) added, count(*) filter (l.doc_id is not null) updated from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def k11_upsert_counts(spark, sf_dir):
    """How many keys of a new set are added to a table, and how many replace a row of it."""
    held = load(spark, sf_dir, "labels", "doc_id").distinct().withColumn("held", F.lit(True))
    new = load(spark, sf_dir, "documents", "doc_id").join(held, "doc_id", "left")
    return new.agg(F.count_if(F.col("held").isNull()).alias("added"), F.count_if(F.col("held").isNotNull()).alias("updated"))


@query("""with s as (select l_orderkey batch, l_partkey item, case when l_quantity < 25 then 'low' else 'high' end state from lineitem), i as (select p_partkey item, p_size % 9 = 0 gone, case when p_size < 25 then 'low' else 'high' end state from part where p_partkey % 50 <> 0),
    j as (select batch, s.item, case when count(*) over (partition by batch, s.item) > 1 then 'duplicate' when i.item is null then 'unknown' when gone then 'skipped' when s.state = i.state then 'unchanged' else 'saved' end outcome from s left join i on s.item = i.item)
    select batch, case when count(*) filter (outcome in ('duplicate', 'unknown')) > 0 then 0 else count(*) filter (outcome = 'saved') end saved, count(*) filter (outcome = 'skipped') skipped, count(*) filter (outcome in ('duplicate', 'unknown')) errors from j group by 1""")
def r4_save_batches(spark, sf_dir):
    """Batches of states: an item twice or unknown rejects its batch, a deleted item is skipped, an equal state changes nothing."""
    sent = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("item"), F.when(F.col("l_quantity") < 25, "low").otherwise("high").alias("state"))
    part = load(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_partkey % 50 <> 0")
    items = part.select(F.col("p_partkey").alias("item"), (F.col("p_size") % 9 == 0).alias("deleted"), F.when(F.col("p_size") < 25, "low").otherwise("high").alias("state"))
    return validate_save(sent, items)


@query("""with t as (select conv_id, turn, coalesce(text, '') x, turn % 3 = 1 gone, row_number() over (partition by conv_id order by turn nulls first, role nulls first, coalesce(text, '')) n from conversations),
    d as (select *, min(case when not gone then n end) over (partition by conv_id order by n rows between 1 following and unbounded following) next from t)
    select d.conv_id, d.turn, t.turn target, md5(rtrim(d.x, ' ') || chr(10) || t.x) merged from d join t on t.conv_id = d.conv_id and t.n = d.next where d.gone""")
def r6_merge_into_next(spark, sf_dir):
    """A deleted item's text goes in front of the next live one; items of one turn go by role, then text."""
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("x"), (F.col("turn") % 3 == 1).alias("gone"))
    later = Window.partitionBy("conv_id").orderBy("turn", "role", "x").rowsBetween(1, Window.unboundedFollowing)
    live = F.when(~F.col("gone"), F.struct("turn", "x"))
    found = rows.withColumn("to", F.first(live, ignorenulls=True).over(later)).filter("gone and to is not null")
    return found.select("conv_id", "turn", F.col("to.turn").alias("target"), F.md5(F.concat(F.rtrim("x"), F.lit("\n"), F.col("to.x"))).alias("merged"))
