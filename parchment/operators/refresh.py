"""Refreshing reviewed rows and checking batches of saves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, body, label, reviewed, modified) of new (id, source, label), with what reviewers did to old (id, source, body, label, reviewed).

    A body follows its source unless it was edited; a label follows the run unless it was reviewed; modified says that
    either differs from the run. Rows that the run lacks go.
    """
    n, o = new.alias("n"), old.alias("o")
    untouched = F.col("o.id").isNull() | F.col("o.body").eqNullSafe(F.col("o.source"))
    body = F.when(untouched, F.col("n.source")).otherwise(F.col("o.body"))
    label = F.when(F.col("o.reviewed"), F.col("o.label")).otherwise(F.col("n.label"))
    modified = ~body.eqNullSafe(F.col("n.source")) | ~label.eqNullSafe(F.col("n.label"))
    return n.join(o, F.col("n.id") == F.col("o.id"), "left").select(F.col("n.id").alias("id"), body.alias("body"), label.alias("label"), F.coalesce("o.reviewed", F.lit(False)).alias("reviewed"), modified.alias("modified"))


def validate_save(sent: DataFrame, items: DataFrame) -> DataFrame:
    """(batch, saved, skipped, errors) of sent (batch, item, state) against items (item, deleted, state).

    Rows of an item that a batch holds twice, and unknown items, are errors; a batch with an error saves nothing. Deleted
    items are skipped. Sent rows are combined by batch and item before they meet the items.
    """
    once = sent.groupBy("batch", "item").agg(F.count("*").alias("n"), F.max("state").alias("state")).alias("s")
    both = once.join(items.alias("i"), F.col("s.item") == F.col("i.item"), "left")
    error = (F.col("n") > 1) | F.col("i.item").isNull()
    skipped, same = F.col("i.deleted"), F.col("s.state").eqNullSafe(F.col("i.state"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    out = both.groupBy("s.batch").agg(count(~error & ~skipped & ~same).alias("saved"), count(~error & skipped).alias("skipped"), count(error).alias("errors"))
    return out.select("batch", F.when(F.col("errors") > 0, 0).otherwise(F.col("saved")).alias("saved"), "skipped", "errors")
