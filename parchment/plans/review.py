"""Reconciling, routing, review decisions and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.reconcile import reconcile
from ..sources.tables import load
from .registry import query


@query("""with d as (select doc_id id, source folder, md5(text) name, n_chars stamp, doc_id % 13 = 0 gone from documents where doc_id % 10 <> 3),
    s as (select doc_id id, case when doc_id % 11 = 0 then 'moved' else source end folder, case when doc_id % 7 = 0 then 'renamed' else md5(text) end name, n_chars + (case when doc_id % 5 = 0 then 1 else 0 end) stamp from documents where doc_id % 10 <> 4)
    select bucket, count(*) n from (select case when d.id is null then 'created' when s.id is null then case when d.gone then 'absent' else 'deleted' end when d.gone then 'restored' when d.name <> s.name then 'renamed'
        when d.stamp <> s.stamp then 'updated' when d.folder <> s.folder then 'moved' else 'unchanged' end bucket from d full join s on d.id = s.id) group by 1""")
def r1_reconcile(spark, sf_dir):
    """Two snapshots made of the documents table: some rows missing on either side, some changed."""
    rows = load(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")
    i = F.col("doc_id")
    known = rows.filter(i % 10 != 3).select(i.alias("id"), F.col("source").alias("folder"), F.md5("text").alias("name"), F.col("n_chars").alias("stamp"), (i % 13 == 0).alias("deleted"))
    seen = rows.filter(i % 10 != 4).select(
        i.alias("id"), F.when(i % 11 == 0, "moved").otherwise(F.col("source")).alias("folder"), F.when(i % 7 == 0, "renamed").otherwise(F.md5("text")).alias("name"), (F.col("n_chars") + F.when(i % 5 == 0, 1).otherwise(0)).alias("stamp")
    )
    return reconcile(seen, known).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""select event_id, array_to_string(list_filter([case when event_type = 'error' then 'failed' end, case when value < 5 then 'low_confidence' end, case when event_type = 'purchase' then 'high_risk' end], lambda x: x is not null), ',') reasons,
    event_type in ('error', 'purchase') or value < 5 needs_review from events""")
def m20_review_routing(spark, sf_dir):
    """Reasons in a fixed order."""
    kind, low = F.col("event_type"), F.col("value") < 5
    reasons = F.array_compact(F.array(F.when(kind == "error", "failed"), F.when(low, "low_confidence"), F.when(kind == "purchase", "high_risk")))
    return load(spark, sf_dir, "events", "event_id", "event_type", "value").select("event_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("needs_review"))


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'rejected' when l_linestatus = 'O' and l_returnflag = 'N' then 'accepted' else 'corrected' end decision from lineitem""")
def r3_decision(spark, sf_dir):
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").select(
        "l_orderkey", "l_linenumber", F.when(flag == "R", "rejected").when((F.col("l_linestatus") == "O") & (flag == "N"), "accepted").otherwise("corrected").alias("decision")
    )


@query("""select o_orderkey, case when count(*) = count(*) filter (l_linestatus = 'F') then 'reviewed' when count(*) filter (l_linestatus = 'F') > 0 then 'in_review' else 'pending' end status from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def r8_review_status(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    orders = load(spark, sf_dir, "orders", "o_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select("o_orderkey", F.when(F.col("n") == F.col("done"), "reviewed").when(F.col("done") > 0, "in_review").otherwise("pending").alias("status"))


@query("""select doc_id, case when toxic = 1 then 'remove' when quality = 1 then 'publish' else 'keep' end action from documents join labels using (doc_id)""")
def r10_publish_set(spark, sf_dir):
    rows = load(spark, sf_dir, "documents", "doc_id").join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.when(F.col("toxic") == 1, "remove").when(F.col("quality") == 1, "publish").otherwise("keep").alias("action"))


@query("select user_id, arg_max(props, (ts, event_id)) note from events group by 1")
def r12_last_note(spark, sf_dir):
    return load(spark, sf_dir, "events", "user_id", "props", "ts", "event_id").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("note"))


@query("select doc_id, count(*) n from labels group by 1 having count(*) > 1 or bool_or(quality not in (0, 1)) or bool_or(toxic not in (0, 1))")
def x_label_violations(spark, sf_dir):
    """Constraint: one label a document, flags of 0 or 1. Gives no row where the table is sound."""
    rows = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).alias("bad"))
    return rows.filter("n > 1 or bad").select("doc_id", "n")
