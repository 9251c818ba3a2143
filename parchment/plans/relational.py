"""Joins, set operations and pages of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from .registry import query


@query("""select o_orderkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey where o_orderstatus = 'F'""")
def j1_star(spark, sf_dir):
    """Nullable keys: left joins; Spark broadcasts the small sides by their sizes."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'")
    customer, nation, region = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey"), load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    out = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, customer.c_nationkey == nation.n_nationkey, "left").join(region, nation.n_regionkey == region.r_regionkey, "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("select c_custkey, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '') orders from customer left join orders on c_custkey = o_custkey group by 1")
def j2_prefetch(spark, sf_dir):
    customers = load(spark, sf_dir, "customer", "c_custkey")
    lists = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("orders"))
    return customers.join(lists, customers.c_custkey == lists.o_custkey, "left").select("c_custkey", F.coalesce("orders", F.lit("")).alias("orders"))


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1)")
def j6_left_anti(spark, sf_dir):
    good = load(spark, sf_dir, "labels", "doc_id", "quality").filter("quality = 1")
    return load(spark, sf_dir, "documents", "doc_id").join(good, "doc_id", "left_anti")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def j8_left_semi(spark, sf_dir):
    customer, orders = load(spark, sf_dir, "customer", "c_custkey"), load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").filter("o_totalprice > 100000")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_semi")


@query("select c_custkey, o_orderkey latest from customer left join (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) o_orderkey from orders group by 1) on c_custkey = o_custkey")
def j11_latest_of_each(spark, sf_dir):
    customer = load(spark, sf_dir, "customer", "c_custkey")
    last = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest"))
    return customer.join(last, customer.c_custkey == last.o_custkey, "left").select("c_custkey", "latest")


@query("""with q as (select user_id, max(ts) queued from events where event_type = 'signup' and ts >= timestamp '2024-01-20' group by 1)
    select user_id, queued from q where not exists (select 1 from events e where e.user_id = q.user_id and e.event_type in ('purchase', 'error') and e.ts >= queued and e.ts < queued + interval 2 day)""")
def j17_in_flight(spark, sf_dir):
    """The latest start of each user with no end event at or after it; both sides are combined by user first."""
    rows = load(spark, sf_dir, "events", "user_id", "event_type", "ts")
    queued = rows.filter((F.col("event_type") == "signup") & (F.col("ts") >= "2024-01-20")).groupBy("user_id").agg(F.max("ts").alias("queued"))
    ends = rows.filter(F.col("event_type").isin("purchase", "error"))
    near = (ends["ts"] >= queued["queued"]) & (ends["ts"] < queued["queued"] + F.expr("interval 2 days"))
    return queued.join(ends, (queued["user_id"] == ends["user_id"]) & near, "left_anti")


@query("""select a.l_orderkey o, a.l_linenumber line, count(b.l_linenumber) below from (select distinct l_orderkey, l_linenumber from lineitem) a left join (select distinct l_orderkey, l_linenumber from lineitem) b
    on a.l_orderkey = b.l_orderkey and b.l_linenumber > a.l_linenumber and b.l_linenumber <= a.l_linenumber + 2 group by 1, 2""")
def j18_subtree_range(spark, sf_dir):
    """Rows within (n, n + 2] of each, in the same tree."""
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    near = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") > F.col("a.l_linenumber")) & (F.col("b.l_linenumber") <= F.col("a.l_linenumber") + 2)
    return a.join(b, near, "left").groupBy(F.col("a.l_orderkey").alias("o"), F.col("a.l_linenumber").alias("line")).agg(F.count("b.l_linenumber").alias("below"))


@query("select o_orderkey, o_totalprice, (select count(*) from orders) total from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def o1_page(spark, sf_dir):
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).crossJoin(F.broadcast(total))


@query("select p_partkey from part except select l_partkey from lineitem")
def u2_difference(spark, sf_dir):
    return load(spark, sf_dir, "part", "p_partkey").subtract(load(spark, sf_dir, "lineitem", "l_partkey"))


@query("select c_nationkey k from customer union select s_nationkey from supplier")
def u4_union_of_keys(spark, sf_dir):
    return load(spark, sf_dir, "customer", "c_nationkey").toDF("k").union(load(spark, sf_dir, "supplier", "s_nationkey").toDF("k")).distinct().filter("k is not null")


@query("select 'created' bucket, o_orderkey k from orders where o_orderstatus = 'O' union all select 'updated', o_orderkey from orders where o_orderstatus = 'P'")
def u5_concatenation(spark, sf_dir):
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    part = lambda s, name: rows.filter(F.col("o_orderstatus") == s).select(F.lit(name).alias("bucket"), F.col("o_orderkey").alias("k"))
    return part("O", "created").unionByName(part("P", "updated"))
