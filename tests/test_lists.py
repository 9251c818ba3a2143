"""Lists, saves and persisted rows at the edges of their rules."""

import random

import pytest
from pyspark.sql import functions as F

from parchment.operators import lifecycle, listing, review
from parchment.sources.shared import new_path


def test_pages(spark):
    rows = spark.range(1000)
    order = [F.desc("id")]
    first = listing.page(rows, order, 3, 0).collect()
    assert [r.id for r in first] == [999, 998, 997] and first[0].total == 1000 and first[0].has_more
    assert listing.page(rows, order, 0, 0).collect() == []
    many = listing.page(rows, order, 999, 900).collect()
    assert len(many) == 100 and not many[0].has_more
    assert listing.page(rows, order, 999, 0).count() == listing.MOST
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError, match="negative"):
            listing.page(rows, order, *bad)
    assert listing.unknown(["b", "x", "x", "a"], ["a", "b"]) == ["x"]


def winners(rows):
    """The rule row by row."""
    held, first = {}, {}
    for n, (id, name, status, review_status, has_run, pages) in enumerate(rows):
        key = "=" + name.strip(" ").lower() if name and name.strip(" ") else f"#{id}"
        published = status == "published" or review_status == "published"
        classified, extracted = status == "classified" or bool(has_run), status in ("extracted", "extracted_with_warnings")
        new = (published, classified, extracted, pages or 0, id)
        if key not in held:
            held[key], first[key] = new, n
            continue
        old = held[key]
        if new[0] != old[0]:
            take = new[0]
        elif new[1] != old[1]:
            take = new[1]
        else:
            take = (new[2] and not old[2]) or new[3] > old[3]
        if take:
            held[key] = new
    return {k: (v[4], first[k]) for k, v in held.items()}


def test_merging_by_name_equals_the_rule(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice(["A", " a ", "b", "B ", None, "  ", "c"]), rng.choice(["published", "classified", "extracted", "extracted_with_warnings", "rejected", None]), rng.choice(["published", "pending", "pending", None]), rng.choice([True, False, False, None]), rng.choice([None, 0, 1, 5, 9])) for n in range(300)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "id long, name string, extraction_status string, review_status string, has_run boolean, pages int, n int").repartition(5)
    got = {r.key: (r.id, r.place.n) for r in listing.one_of_each_name(df, ["n"]).collect()}
    assert got == winners(rows)


ITEM = "run_id string, chunk_id string, ord int, deleted boolean, decision string, label string, type_key string, sub_type string, r_label string, r_type string, r_sub string"
SENT = "sid string, run_id string, chunk_id string, present string, label string, type_key string, sub_type string"


def test_one_error_saves_nothing(spark):
    items = spark.createDataFrame(
        [(r, c, n, c == "c3", None, "Clause", "term", None, None, None, None) for r in ("a", "b", "d", "e") for n, c in enumerate(("c1", "c2", "c3"))] + [("f", "c1", 0, False, "accepted", "Clause", "term", None, "Clause", "term", None), ("g", "c1", 0, False, None, None, None, None, None, None, None)],
        ITEM,
    )
    same, other = ("", None, None, None), ("label,type", "Clause", "notice", None)
    sent = [("a", "c1", *same), ("a", "c2", *other), ("a", "c3", *other), ("b", "c1", *same), ("b", "zz", *same), ("d", "c1", *same), ("d", "c1", *other), ("e", "c1", "label", "Wrong", None, None), ("f", "c1", *same), ("g", "c1", *same)]
    totals, log = review.saved(items, spark.createDataFrame([(f"{n}", *s) for n, s in enumerate(sent)], SENT))
    got = {r.run_id: (r.errors, r.skipped, r.unchanged, r.accepted, r.corrected) for r in totals.collect()}
    assert got == {"a": (0, 1, 0, 1, 1), "b": (1, 0, 0, 0, 0), "d": (2, 0, 0, 0, 0), "e": (1, 0, 0, 0, 0), "f": (0, 0, 1, 0, 0), "g": (1, 0, 0, 0, 0)}
    assert {r.run_id for r in log.collect()} == {"a"} and sorted((r.ord, r.field, r["from"], r["to"]) for r in log.collect() if r.ord == 1) == [(1, "decision", None, "corrected"), (1, "label", None, "Clause"), (1, "type", None, "notice")]


def test_deleting_into_the_next_live_item(spark):
    items = spark.createDataFrame([("r", 1, "one  ", None, False), ("r", 2, "two", "", True), ("r", 3, "three", "3", False), ("s", 1, "last", None, False), ("t", 1, "gone ", None, False), ("t", 2, None, None, False)], "run_id string, ord int, source_text string, edited string, deleted boolean")
    gone = spark.createDataFrame([("r", 1), ("s", 1), ("t", 1)], "run_id string, ord int")
    got = {(r.run_id, r.ord): (r.text, r.deleted, r.merged_into) for r in review.deleted_into_next(items, gone).collect()}
    assert got == {("r", 1): ("one  ", True, 3), ("r", 2): ("", True, None), ("r", 3): ("one\n3", False, None), ("s", 1): ("last", True, None), ("t", 1): ("gone ", True, 2), ("t", 2): ("gone\n", False, None)}


def test_appends_run_again_without_effect(spark):
    path, kind = new_path(spark, "absent"), "k int, v string"
    first = spark.createDataFrame([(1, "a"), (1, "A"), (2, "b")], kind)
    assert lifecycle.append_absent(path, first, ["k"]) == 2 and lifecycle.append_absent(path, first, ["k"]) == 0
    assert lifecycle.append_absent(path, spark.createDataFrame([(2, "x"), (3, "c")], kind), ["k"]) == 1
    assert sorted(map(tuple, spark.read.schema(kind).parquet(path).collect())) == [(1, "A"), (2, "b"), (3, "c")]


def test_front_matter(spark):
    lines = [("Master Agreement", 0), ("Page 1 of 3", None), ("This is made between the parties", None), ("Draft", None), ("A full sentence. It goes on", None), ("", None), ("1. Scope", None), ("Page 2", None)]
    df = spark.createDataFrame([(1, n, t, None, "body", h) for n, (t, h) in enumerate(lines)] + [(2, 0, "no number", None, "body", None), (2, 1, None, None, "body", None), (2, 2, "Contents", "TOC 1", "body", None), (2, 3, "1. cell", None, "table", None)], "doc int, ord int, text string, style string, kind string, heading int")
    got = {(r.doc, r.ord): (r.bucket, r.front_matter) for r in lifecycle.segmented(df).collect()}
    assert [got[1, n] for n in range(8)] == [("document_title", False), ("intro_removed", False), ("content", True), ("intro_removed", False), ("content", True), ("empty", False), ("content", False), ("content", False)]
    assert [got[2, n] for n in range(4)] == [("content", False), ("empty", False), ("toc", False), ("table", False)]
    assert {r.title for r in lifecycle.segmented(df).filter("doc = 1").collect()} == {"Master Agreement"}
