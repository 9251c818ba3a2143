"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and a sum over them, which tell whether a step changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node that it reaches.

    Each step joins edges with the least neighbour of their nodes, an aggregate of one row a node, and writes them to the
    shared folder; the number of steps grows with the logarithm of the longest path. Self-loops, repeated and reversed
    edges are allowed; edges with a null end are left out. No edges give an empty table.
    """
    now = stash(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        # Large star: larger neighbours of u move to the least node around u.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.filter("u <> v").distinct())
        # Small star: smaller neighbours of u, and u, move to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.greatest("e.v", "e.m").alias("u"), F.least("e.v", "e.m").alias("v"))
        then = stash(moved.filter("u <> v").distinct())
        unstash(now, large)
        now = then
        last, mark = mark, _mark(now)
        if mark == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
