"""Attempts, current runs, siblings, gaps and bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import load
from .registry import query


@query("select o_orderkey, o_custkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as integer) attempt from orders")
def w1_attempt_number(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", F.row_number().over(order).alias("attempt"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r = 1")
def w2_current_run(spark, sf_dir):
    """The latest attempt, whatever its status; an aggregate, so a hot key is combined before the shuffle."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return rows.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders where o_orderstatus = 'F') where r = 1")
def w3_current_finished_run(spark, sf_dir):
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").filter("o_orderstatus = 'F'")
    return rows.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


@query("select l_orderkey, l_linenumber, cast(row_number() over w as integer) sibling_index, cast(count(*) over (partition by l_orderkey) as bigint) sibling_count from lineitem window w as (partition by l_orderkey order by l_linenumber)")
def w7_siblings(spark, sf_dir):
    own = Window.partitionBy("l_orderkey")
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.row_number().over(own.orderBy("l_linenumber")).alias("sibling_index"), F.count("*").over(own).alias("sibling_count"))


@query("""select * from (select l_orderkey, l_linenumber, l_linenumber - last_value(case when l_returnflag <> 'N' then l_linenumber end ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding) gap
    from lineitem) where gap > 1""")
def w8_sequence_gap(spark, sf_dir):
    """Against the last sibling that has a number, not the neighbour."""
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")
    last = F.last(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")), ignorenulls=True).over(before)
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - last).alias("gap")).filter("gap > 1")


@query("select l_orderkey, l_linenumber, cast(dense_rank() over (partition by l_orderkey order by l_quantity) - 1 as integer) rank from lineitem")
def w9_outline_rank(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_quantity")
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", (F.dense_rank().over(order) - 1).alias("rank"))


@query("""select l_orderkey, l_linenumber, cast(sum(case when l_quantity - p > 10 then 1 else 0 end) over (partition by l_orderkey order by l_quantity, l_linenumber rows unbounded preceding) as bigint) band
    from (select *, lag(l_quantity) over (partition by l_orderkey order by l_quantity, l_linenumber) p from lineitem)""")
def w10_bands(spark, sf_dir):
    """Islands of values no more than 10 apart."""
    order = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber")
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn("p", F.lag("l_quantity").over(order))
    new = F.when(F.col("l_quantity") - F.col("p") > 10, 1).otherwise(0)
    return rows.select("l_orderkey", "l_linenumber", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("band"))


@query("select conv_id, turn, max(length(text)) over (partition by conv_id order by turn rows unbounded preceding) longest from conversations")
def w11_running_max(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.max(F.length("text").cast("long")).over(order).alias("longest"))


@query("""select k, doc_id from (select coalesce(nullif(lower(trim(text)), ''), 'id:' || doc_id) k, doc_id, row_number() over (partition by coalesce(nullif(lower(trim(text)), ''), 'id:' || doc_id) order by n_chars desc, doc_id) r from documents) where r = 1""".replace("select k, doc_id", "select md5(k) k, doc_id", 1))
def w12_dedup_winner(spark, sf_dir):
    """The winner of each name; rows without a name are never merged."""
    name = F.lower(F.trim("text"))
    key = F.when(name != "", name).otherwise(F.concat(F.lit("id:"), F.col("doc_id").cast("string")))
    rows = load(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select(F.md5(key).alias("k"), "doc_id", "n_chars")
    return rows.groupBy("k").agg(F.min(F.struct(-F.col("n_chars"), "doc_id"))["doc_id"].alias("doc_id"))


@query("select conv_id, turn, lag(turn) over w before, lead(turn) over w next from conversations window w as (partition by conv_id order by turn)")
def w14_neighbours(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", F.lag("turn").over(order).alias("before"), F.lead("turn").over(order).alias("next"))


@query("select conv_id, turn, min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following) next_live from conversations")
def j16_next_live(spark, sf_dir):
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return load(spark, sf_dir, "conversations", "conv_id", "turn", "role").select("conv_id", "turn", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(after).alias("next_live"))
