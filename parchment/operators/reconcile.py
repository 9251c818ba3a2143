"""Reconciling a source snapshot with the known documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(id, bucket) of each id of seen (id, folder, name, stamp) and known (the same, and deleted): exactly one bucket each.

    Ids of one side only are created, or deleted (absent, if they were deleted before). Others are compared in the order
    restored, renamed, updated, moved, unchanged. Null names, stamps and folders are values like others.
    """
    a, b = seen.alias("a"), known.alias("b")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    bucket = (
        F.when(F.col("b.id").isNull(), "created")
        .when(F.col("a.id").isNull() & F.col("b.deleted"), "absent")
        .when(F.col("a.id").isNull(), "deleted")
        .when(F.col("b.deleted"), "restored")
        .when(differs("name"), "renamed")
        .when(differs("stamp"), "updated")
        .when(differs("folder"), "moved")
        .otherwise("unchanged")
    )
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(F.coalesce("a.id", "b.id").alias("id"), bucket.alias("bucket"))
