"""Pages of lists, tabs, and lists in which rows of one name are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running

#: Rows of a page at most, and without a limit.
MOST, DEFAULT = 200, 50


def page(rows: DataFrame, order: list[Column], limit: int = DEFAULT, offset: int = 0) -> DataFrame:
    """The rows of a page with `total`, the rows there are, and `has_more`.

    A limit of 0 gives no row, so no total either: ask for `total` apart. A negative number is an error; above MOST, MOST rows come. The order
    must be total. Only the rows up to the page's end meet in one task.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    size = min(limit, MOST)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    found = rows.orderBy(*order).offset(offset).limit(size)
    return found.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + size)


def unknown(requested: list[str], allowed: list[str]) -> list[str]:
    """What was asked for and does not exist, in order."""
    return [r for r in dict.fromkeys(requested) if r not in allowed]


#: The tabs of the document list.
PUBLISHED = ("Published", "Updated to vector DB")
TABS = ("needs-review", "in-review", "draft", "saved", "reviewed", "extracted", "warnings", "rejected", "published")


def tabs() -> list[Column]:
    """Whether a row belongs to each of TABS."""
    status, extracted = F.col("status"), F.col("extraction_status")
    tests = [
        (F.col("needs_review") > 0) | (status == "Needs review"),
        (status == "In review") | (F.coalesce("current_reviewer", F.lit("")) != ""),
        (status == "Draft") | (extracted == "rejected"),
        status == "Saved",
        status == "Reviewed",
        extracted == "extracted",
        (extracted == "extracted_with_warnings") | F.col("warned"),
        extracted == "rejected",
        status.isin(*PUBLISHED) | (F.col("review_status") == "published"),
    ]
    return [F.coalesce(t, F.lit(False)) for t in tests]


def _wins(held: tuple, new: tuple) -> bool:
    """Whether a row (published, classified, extracted, pages) takes the place of the one before it with its name."""
    for k in (0, 1):
        if held[k] != new[k]:
            return new[k]
    return (new[2] and not held[2]) or new[3] > held[3]


def one_of_each_name(rows: DataFrame, order: list[str], id: str = "id") -> DataFrame:
    """(key, id, place): of the rows with one name, but for case and spaces around it, the one that wins, at the place of the first.

    Row by row in the list's order: a published one replaces one that is not, else a classified one, else an extracted one, or one of
    more pages. As the last two do not form an order, this is a fold, with one row of state a name. A row without a name is alone.
    """
    status = F.lower(F.coalesce("extraction_status", F.lit("")))
    name = F.lower(F.btrim(F.coalesce("name", F.lit(""))))
    key = F.when(name == "", F.concat(F.lit("#"), F.col(id))).otherwise(F.concat(F.lit("="), name))
    ranked = rows.select(
        key.alias("key"), id, *[c for c in order if c != id],
        ((status == "published") | (F.coalesce("review_status", F.lit("")) == "published")).alias("published"),
        ((status == "classified") | F.coalesce("has_run", F.lit(False))).alias("classified"),
        status.isin("extracted", "extracted_with_warnings").alias("extracted"), F.coalesce("pages", F.lit(0)).alias("pages"),
    )

    def step(held, published, classified, extracted, pages, own):
        new = (published, classified, extracted, pages)
        return ((new, own), own) if held is None or _wins(held[0], new) else (held, held[1])

    led = running(ranked, "key", order, ["published", "classified", "extracted", "pages", id], lambda: None, step, "leader")
    at = F.struct(*order)
    return led.groupBy("key").agg(F.max_by("leader", at).alias(id), F.min(at).alias("place"))
