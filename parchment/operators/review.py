"""The algebra of reviews: routing, decisions, readiness, deletes, restores and publishing. Inputs have the columns of plans.derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rules.
LOW_CONFIDENCE, HIGH_RISK, LABELS = 0.85, ("liability", "indemnity"), ("Clause", "Non-clause")


def current_text() -> Column:
    """The edit, though empty, else the source."""
    return F.coalesce("edited", "source_text")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def routed(items: DataFrame) -> DataFrame:
    """items with deviated, reasons (in fixed order) and needs_review."""
    expected = F.filter(F.split("expected", r"\|"), lambda x: x != "")
    deviated = (F.col("outcome") == "classified") & (F.col("label") == "Clause") & (F.size(expected) > 0) & ~F.coalesce(F.array_contains(expected, F.col("type_key")), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("outcome").isin("failed", "unclassified"), F.col("outcome")),
            F.when(F.col("confidence") < LOW_CONFIDENCE, "low_confidence"),
            F.when(F.col("type_key").isin(*HIGH_RISK), "high_risk"),
            F.when(deviated, "deviated"),
        )
    )
    return items.withColumn("deviated", F.coalesce(deviated, F.lit(False))).withColumn("reasons", reasons).withColumn("needs_review", F.size("reasons") > 0)


def _judged(items: DataFrame, submitted: DataFrame, how: str) -> DataFrame:
    """submitted joined with the items of its (run_id, chunk_id): the item as `i`, the triple that a submission comes to, and its verdict.

    Fields that are absent keep the current value: the reviewer's, or the model's if there is none or the item was rejected. A triple
    that is the model's is accepted, another valid one corrected, else it is an error; a Non-clause has no sub-type.
    """
    fields = F.struct("ord", "deleted", "decision", "label", "type_key", "sub_type", "r_label", "r_type", "r_sub")
    joined = submitted.join(items.select("run_id", "chunk_id", fields.alias("i")), ["run_id", "chunk_id"], how)
    own = F.col("i.decision").isin("accepted", "corrected")

    def value(field: str, mine: str, model: str) -> Column:
        present = F.array_contains(F.split("present", ","), field)
        return F.when(present, F.nullif(F.col(model), F.lit(""))).when(F.coalesce(own, F.lit(False)), F.col(f"i.{mine}")).otherwise(F.col(f"i.{model}"))

    rows = joined.select("sid", "run_id", "chunk_id", "i", value("label", "r_label", "label").alias("label"), value("type", "r_type", "type_key").alias("type_key"), value("sub", "r_sub", "sub_type").alias("sub"))
    rows = rows.withColumn("sub_type", F.when(F.col("label") == "Non-clause", None).otherwise(F.col("sub"))).drop("sub")
    same = F.col("label").eqNullSafe(F.col("i.label")) & F.col("type_key").eqNullSafe(F.col("i.type_key")) & F.col("sub_type").eqNullSafe(F.col("i.sub_type"))
    verdict = F.when(same & F.col("i.label").isNull(), "error: no model label").when(same, "accepted").when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "error: label").when(F.col("type_key").isNull(), "error: type").otherwise("corrected")
    return rows.withColumn("verdict", verdict)


def decided(items: DataFrame, submitted: DataFrame) -> DataFrame:
    """(sid, verdict, label, type_key, sub_type) of submissions for the items of their run and chunk."""
    return _judged(items, submitted, "inner").select("sid", "verdict", "label", "type_key", "sub_type")


def saved(items: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((run_id, errors, skipped, unchanged, accepted, corrected), (run_id, ord, field, from, to)): saves of runs, and their change logs.

    An item that is not there once and only once is an error, as is a chunk that a save names twice, or a verdict that is one; a deleted item is skipped; a
    state that is there already is unchanged. One error, and nothing of its run is saved or logged.
    """
    once = items.join(items.groupBy("run_id", "chunk_id").count().filter("count = 1").select("run_id", "chunk_id"), ["run_id", "chunk_id"], "left_semi")
    twice = submitted.groupBy("run_id", "chunk_id").count().filter("count > 1").select("run_id", "chunk_id", F.lit(True).alias("twice"))
    rows = _judged(once, submitted, "left").join(twice, ["run_id", "chunk_id"], "left")
    now = F.col("verdict").eqNullSafe(F.col("i.decision")) & F.col("label").eqNullSafe(F.col("i.r_label")) & F.col("type_key").eqNullSafe(F.col("i.r_type")) & F.col("sub_type").eqNullSafe(F.col("i.r_sub"))
    outcome = F.when(F.col("twice") | F.col("i").isNull(), "error").when(F.col("i.deleted"), "skipped").when(F.startswith("verdict", F.lit("error")), "error").when(now, "unchanged").otherwise(F.col("verdict"))
    rows = rows.withColumn("outcome", outcome)
    count = lambda o: F.count_if(F.col("outcome") == o)
    sound = count("error") == 0
    totals = rows.groupBy("run_id").agg(count("error").alias("errors"), count("skipped").alias("skipped"), count("unchanged").alias("unchanged"), *[F.when(sound, count(o)).otherwise(0).alias(o) for o in ("accepted", "corrected")])
    kept = rows.filter(F.col("outcome").isin("accepted", "corrected")).join(totals.filter("errors = 0").select("run_id"), "run_id", "left_semi")
    moves = [("decision", F.col("i.decision"), F.col("outcome")), ("label", F.col("i.r_label"), F.col("label")), ("type", F.col("i.r_type"), F.col("type_key")), ("sub_type", F.col("i.r_sub"), F.col("sub_type"))]
    move = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), a.alias("from"), b.alias("to")) for f, a, b in moves]))
    return totals, kept.select("run_id", F.col("i.ord").alias("ord"), move.alias("m")).select("run_id", "ord", "m.*").filter(~F.col("from").eqNullSafe(F.col("to")))


def readiness(items: DataFrame) -> DataFrame:
    """What keeps each document from publishing: counts over its live items, and whether all are deleted."""
    live, undecided = ~F.col("deleted"), F.col("decision").isNull()
    typeless = F.col("label").isNull() | ((F.col("label") == "Clause") & F.col("type_key").isNull())
    unfixed = F.col("decision").isin("accepted", "corrected") & (F.col("r_label") == "Clause") & F.col("r_type").isNull()
    return items.groupBy("document_id").agg(
        F.count_if(live & undecided & F.col("flagged")).alias("needs_review"),
        F.count_if(live & ((undecided & ~F.col("flagged") & typeless) | F.coalesce(unfixed, F.lit(False)))).alias("missing_type"),
        F.count_if(live & F.coalesce(current_text(), F.lit("")).rlike(r"^\s*$")).alias("empty_text"),
        F.count_if(live & (F.col("decision") == "rejected")).alias("rejected"),
        (F.count_if(live) == 0).alias("all_deleted"),
    )


def deleted_into_next(items: DataFrame, gone: DataFrame) -> DataFrame:
    """(run_id, ord, text, deleted, merged_into) of all items after one of a run, (run_id, ord) in `gone`, is deleted and merged into the next live one (merged_into is its ord).

    A run has one such item at most: a save deletes them one after the other.
    """
    mine = items.select("run_id", F.col("ord").alias("g_ord"), F.coalesce(_stripped(current_text()), F.lit("")).alias("g_text"))
    hit = gone.select("run_id", F.col("ord").alias("g_ord")).join(mine, ["run_id", "g_ord"])
    target = items.filter("not deleted").join(hit, "run_id").filter("ord > g_ord").groupBy("run_id").agg(F.min("ord").alias("target"))
    state = items.join(hit.join(target, "run_id", "left"), "run_id", "left")
    is_hit, is_target = F.coalesce(F.col("ord") == F.col("g_ord"), F.lit(False)), F.col("ord") == F.col("target")
    text = F.when(is_target, F.concat("g_text", F.lit("\n"), F.coalesce(current_text(), F.lit("")))).otherwise(current_text())
    return state.select("run_id", "ord", text.alias("text"), (F.col("deleted") | is_hit).alias("deleted"), F.when(is_hit, F.col("target")).alias("merged_into"))


def restored(items: DataFrame) -> DataFrame:
    """(run_id, ord, target, unmerged, target_text) for each merged item: its text leaves the target if that is live and starts with it, and holds more."""
    gone = items.filter("deleted and merged_into is not null").alias("g")
    target = items.select("run_id", F.col("chunk_id").alias("merged_into"), current_text().alias("t_text"), F.col("deleted").alias("t_deleted"))
    rows = gone.join(target, ["run_id", "merged_into"]).withColumn("prefix", F.concat(_stripped(F.coalesce(F.nullif("edited", F.lit("")), "source_text")), F.lit("\n")))
    fits = ~F.col("t_deleted") & F.startswith("t_text", "prefix") & (F.length("t_text") > F.length("prefix"))
    return rows.select("run_id", "ord", F.col("merged_into").alias("target"), fits.alias("unmerged"), F.when(fits, F.substring("t_text", F.length("prefix") + 1, F.length("t_text"))).otherwise(F.col("t_text")).alias("target_text"))


def next_status(now: Column, all_decided: Column) -> Column:
    """A document's status after a save: reviewed or in_review, and reopened if it was published or reopened before."""
    again = now.isin("published", "reopened_in_review", "reopened_reviewed")
    return F.concat(F.when(again, "reopened_").otherwise(""), F.when(all_decided, "reviewed").otherwise("in_review"))


def publish_plan(records: DataFrame) -> DataFrame:
    """(document_id, paragraph_id, action, differential): what a publish embeds and removes. A document of which no live record is
    unchanged is published as a whole."""
    new = F.col("is_modified") | F.col("synced_at").isNull()
    action = F.when(F.col("deleted") & (F.col("synced_at").isNotNull() | F.col("vector_id").isNotNull()), "remove").when(~F.col("deleted") & new, "publish")
    differential = F.bool_or(~F.col("deleted") & ~new).over(Window.partitionBy("document_id"))
    return records.select("document_id", "paragraph_id", action.alias("action"), differential.alias("differential")).filter("action is not null")


def reconciled(known: DataFrame, seen: DataFrame, walked: DataFrame) -> DataFrame:
    """(key, bucket) of each seen file and each known document, in one bucket: a known id is compared; an unknown one may be the live
    document of the same name and folder under a new id (updated); live documents that nobody saw are deleted where their folder
    is blank or in scope."""
    by_id = seen.alias("s").join(known.alias("k"), "file_id", "left")
    change = F.when(F.col("k.deleted"), "restored").when(~F.col("s.name").eqNullSafe(F.col("k.name")), "renamed").when(~F.col("s.mtime").eqNullSafe(F.col("k.mtime")), "updated").when(~F.col("s.folder").eqNullSafe(F.col("k.folder")), "moved").otherwise("unchanged")
    direct = by_id.filter("document_id is not null").select("document_id", change.alias("bucket"))
    free = known.filter("not deleted").join(direct, "document_id", "left_anti")
    unknown = by_id.filter("document_id is null").select("file_id", F.col("s.name").alias("name"), F.col("s.folder").alias("folder"))
    # Of several documents of one name and folder, the smallest id is taken.
    slots = free.groupBy("name", "folder").agg(F.min("document_id").alias("document_id"))
    replaced = unknown.alias("u").join(slots.alias("f"), F.col("u.name").eqNullSafe(F.col("f.name")) & F.col("u.folder").eqNullSafe(F.col("f.folder")), "left")
    found = replaced.select(F.coalesce("document_id", "file_id").alias("document_id"), F.when(F.col("document_id").isNotNull(), "updated").otherwise("created").alias("bucket")).distinct()
    scope = walked.select("folder").union(seen.select("folder")).filter("folder is not null").distinct()
    unseen = known.filter("not deleted").join(direct.union(found), "document_id", "left_anti")
    gone = unseen.join(scope.withColumn("inside", F.lit(True)), "folder", "left").select("document_id", F.when(F.col("folder").isNull() | F.col("inside"), "deleted").otherwise("out_of_scope").alias("bucket"))
    return direct.union(found).union(gone)
