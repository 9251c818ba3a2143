"""Trees, batches and size statistics of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def descendants(nodes: DataFrame, tree: str) -> DataFrame:
    """(tree, path, descendants, children) of distinct nodes (tree, path array).

    Each node adds one to every proper prefix of its path, so the counts are one aggregate that is combined before its
    shuffle, not a join of each node with those below it. A prefix that is no node is left out.
    """
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(F.slice("path", F.lit(1), n).alias("path"), (F.size("path") - n).alias("down")))
    each = nodes.select(tree, F.explode(above).alias("e")).groupBy(tree, "e.path")
    counted = each.agg(F.count_if(F.col("e.down") > 0).alias("descendants"), F.count_if(F.col("e.down") == 1).alias("children"), F.count_if(F.col("e.down") == 0).alias("own"))
    return counted.filter("own > 0").drop("own")


def batches(rows: DataFrame, group: str, order: list[str], cost: str, most: int, items: int) -> DataFrame:
    """(group, batch, items, tokens): the rows of a group, in order, put greedily into batches of at most `most` cost and `items` rows.

    A row above `most` is a batch of its own. A group is one document: its costs, one long a row, are folded in the JVM.
    """
    costs = rows.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(cost).alias("_cost")))), lambda x: x["_cost"]).alias("costs"))
    open_ = lambda n, used: F.struct(n.cast("long").alias("items"), used.alias("tokens"))
    state = F.struct(F.array().cast("array<struct<items:long,tokens:long>>").alias("done"), open_(F.lit(0), F.lit(0).cast("long")).alias("now"))

    def add(s, x):
        full = (s["now"]["items"] > 0) & ((s["now"]["items"] + 1 > items) | (s["now"]["tokens"] + x > most))
        closed = F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), open_(F.lit(1), x).alias("now"))
        return F.when(full, closed).otherwise(F.struct(s["done"].alias("done"), open_(s["now"]["items"] + 1, s["now"]["tokens"] + x).alias("now")))

    packed = F.aggregate("costs", state, add, lambda s: F.concat(s["done"], F.array(s["now"])))
    return costs.select(group, F.posexplode(packed).alias("batch", "b")).select(group, "batch", "b.items", "b.tokens")


def upper_median(rows: DataFrame, group: str, size: str) -> DataFrame:
    """(group, median, longest, n): element n // 2 of each group's sorted sizes, by a histogram of sizes, so that no task sorts a whole group."""
    counts = rows.filter(F.col(size).isNotNull()).groupBy(group, size).agg(F.count("*").alias("c"))
    order = Window.partitionBy(group).orderBy(size)
    upto = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(size)))
    return upto.groupBy(group).agg(median.alias("median"), F.max(size).alias("longest"), F.sum("c").alias("n"))
