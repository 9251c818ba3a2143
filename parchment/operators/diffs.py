"""Differences of nested records of any fields, as VARIANT values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Objects inside of objects are opened so many times; what is nested deeper is compared as a whole.
LEVELS = 8


def fields(states: DataFrame) -> DataFrame:
    """(doc, n, path, value) of states (doc, n, state as JSON text): each field that is no object, by its path with points; value is JSON text.

    Objects are opened level by level, all fields of a level at once, whatever they are called; arrays are values. Text that is no JSON
    object has no fields. Null values are fields, with the value null in JSON.
    """
    rows = states.select("doc", "n", F.lit("").alias("path"), F.expr("try_parse_json(state)").alias("v")).filter("v is not null")
    done, opened = None, rows.filter("schema_of_variant(v) like 'OBJECT<%'")
    for level in range(1, LEVELS + 1):
        each = states.sparkSession.sql("select r.doc, r.n, case when r.path = '' then e.key else r.path || '.' || e.key end as path, e.value as v from {r} r, lateral variant_explode(r.v) e", r=opened)
        is_object = F.expr("schema_of_variant(v) like 'OBJECT<%' and schema_of_variant(v) <> 'OBJECT<>'")
        leaf = each.filter(~is_object) if level < LEVELS else each
        done = leaf if done is None else done.unionByName(leaf)
        opened = each.filter(is_object)
    return done.select("doc", "n", "path", F.to_json("v").alias("value"))


def changes(states: DataFrame) -> DataFrame:
    """(doc, n, path, from, to) of each field that differs between a document's state n and the one before it, n - 1; null where it is not there.

    A full join by document, number and path; the first state of a document is compared with nothing.
    """
    rows = fields(states)
    last = states.groupBy("doc").agg(F.max("n").alias("last"))
    before = rows.select("doc", (F.col("n") + 1).alias("n"), "path", F.col("value").alias("from"))
    both = before.join(rows.withColumnRenamed("value", "to"), ["doc", "n", "path"], "full_outer").filter(~F.col("from").eqNullSafe(F.col("to")) & (F.col("n") > 1))
    return both.join(last, "doc").filter(F.col("n") <= F.col("last")).select("doc", "n", "path", "from", "to")


def as_json(changed: DataFrame) -> DataFrame:
    """(doc, n, changes): one object {field: {from, to}} for each state that changed; what is not there is left out."""
    one = F.struct("path", F.struct("from", "to").alias("moved"))
    return changed.groupBy("doc", "n").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(one)))).alias("changes"))
