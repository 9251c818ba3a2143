"""Runs over documents, the rows that they persist, and what a model's answers come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folding import folded
from ..functions.numbers import typed_number
from ..sources.shared import new_path

#: What front matter is without meaning, and words that give it some; characters of a line that may be noise.
NOISE = r"(?i)^\s*(?:page\s*\d|\d+\s*of\s*\d|version\s|v\d+\.\d|confidential\b|draft\b|private\s+and\s+confidential|copyright|\(c\)\s*\d{4}|all\s+rights)"
SUBSTANCE = r"(?i)\b(?:whereas|recital|recitals|background|witnesseth|now\s+therefore|entered\s+into|is\s+made|agreement\s+is|between|by\s+and\s+between|parties|party|effective\s+date|in\s+consideration)\b"
NOISE_CHARS = 50
#: The longest sub-type, and the confidence below which a judge is asked.
SUB_TYPE_CHARS, JUDGED_BELOW = 255, 70


def is_noise(text: Column) -> Column:
    """Whether a line before the body carries nothing: blank, a page number or a mark, or short without a sentence and without a word of substance."""
    t = F.trim(F.coalesce(text, F.lit("")))
    short = (F.length(t) <= NOISE_CHARS) & ~t.rlike(SUBSTANCE)
    return (t == "") | t.rlike(NOISE) | (short & ~F.contains(F.rtrim(t, F.lit(".")), F.lit(".")))


def segmented(lines: DataFrame) -> DataFrame:
    """(doc, ord, bucket, front_matter, title) of lines (doc, ord, text, style, kind, heading): empty, toc, table, document_title, intro_removed or content.

    The body of a document starts at its first typed number in the content; without one nothing is removed. Before it, headings of level 0 are the
    title, or if there are none the first line's text is; noise goes, and what is left is front matter. Three aggregates a document, no lists of its lines.
    """
    blank = F.coalesce("text", F.lit("")) == ""
    bucket = F.when(blank, "empty").when(F.coalesce(F.col("style").rlike(r"(?i)^toc\s*\d*$"), F.lit(False)), "toc").when(F.col("kind") == "table", "table").otherwise("content")
    rows = lines.withColumn("bucket", bucket).withColumn("numbered", (F.col("bucket") == "content") & F.col("heading").isNull() & typed_number(F.col("text")).isNotNull())
    starts = rows.groupBy("doc").agg(F.min(F.when(F.col("numbered"), F.col("ord"))).alias("begin"))
    rows = rows.join(starts, "doc").withColumn("front", (F.col("bucket") == "content") & F.coalesce(F.col("ord") < F.col("begin"), F.lit(False)))
    head = F.col("front") & F.coalesce(F.col("heading") == 0, F.lit(False))
    titles = rows.filter("front").groupBy("doc").agg(F.sort_array(F.collect_list(F.when(head, F.struct("ord", "text")))).alias("heads"), F.min_by("text", "ord").alias("first"))
    title = F.when(F.size("heads") > 0, F.trim(F.array_join("heads.text", " "))).otherwise(F.col("first"))
    kept = ~is_noise(F.col("text"))
    final = F.when(~F.col("front"), F.col("bucket")).when(head, "document_title").when(~kept, "intro_removed").otherwise("content")
    return rows.join(titles.select("doc", title.alias("title")), "doc", "left").select("doc", "ord", final.alias("bucket"), (F.col("front") & ~head & kept).alias("front_matter"), "title")


def clean_title(value: Column) -> Column:
    """A title with single spaces, without quotes around it and stops at its end; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.nullif(F.trim(F.rtrim(F.btrim(t, F.lit("\"'")), F.lit(".:;,"))), F.lit(""))


def post_processed(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """items (id, label, canonical_type, sub_type, confidence, reason) with outcome, type_key, sub_type, reason, notes and error.

    vocabulary is (name, key, applies_to), names unique when folded. An answer without a reason, or whose type is none of its label's, is an error. A Clause
    without a type is unclassified. Sub-types are cleaned, cut at SUB_TYPE_CHARS, and only Clauses have them; notes say what was done.
    """
    known = vocabulary.select(folded(F.col("name")).alias("k"), F.col("name").alias("known_name"), "key", F.col("applies_to").alias("label"))
    rows = items.withColumn("k", folded(F.col("canonical_type"))).join(known, ["k", "label"], "left")
    clause = F.col("label") == "Clause"
    reason = F.nullif(F.trim(F.regexp_replace(F.coalesce("reason", F.lit("")), r"\s+", " ")), F.lit(""))
    title = clean_title(F.col("sub_type"))
    cut = F.when(F.length(title) > SUB_TYPE_CHARS, F.rtrim(F.substring(title, 1, SUB_TYPE_CHARS))).otherwise(title)
    untyped = clause & F.col("canonical_type").isNull()
    error = F.when(reason.isNull(), "empty reason").when(~untyped & F.col("key").isNull(), F.when(clause, "not a clause type").otherwise("not a non-clause type"))
    notes = F.array_compact(F.array(F.when(clause & title.isNull(), "no sub_type given"), F.when(clause & (F.length(title) > SUB_TYPE_CHARS), "sub_type truncated"), F.when(F.col("known_name") != F.col("canonical_type"), "resolved by name")))
    fine = error.isNull()
    return rows.select(
        "id", F.when(fine, F.when(untyped, "unclassified").otherwise("classified")).alias("outcome"), F.when(fine, F.col("label")).alias("label"), F.when(fine, F.col("key")).alias("type_key"),
        F.when(fine & clause, cut).alias("sub_type"), F.when(fine, reason).alias("reason"), F.when(fine, F.array_join(notes, "; ")).alias("notes"), error.alias("error"),
    )


def started(runs: DataFrame) -> DataFrame:
    """(document_id, attempt, status, error) after a new run of each document was started: open runs are closed as abandoned, the new one is one attempt further."""
    held = runs.select("document_id", "attempt", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "running", "abandoned").alias("error"))
    new = runs.groupBy("document_id").agg((F.max("attempt") + 1).alias("attempt")).select("document_id", "attempt", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
    return held.unionByName(new)


def stale(runs: DataFrame, taxonomy: str, prompt: str, model: str, prompt_hash: str) -> DataFrame:
    """(document_id, stale, judged): of each document's last finished run, whether it was made with anything but these, and whether a judge is asked for it."""
    last = runs.filter("status = 'succeeded'").groupBy("document_id").agg(F.max_by(F.struct("taxonomy", "prompt", "model", "prompt_hash", "least_confidence"), "attempt").alias("r"))
    differs = (F.col("r.taxonomy") != taxonomy) | (F.col("r.prompt") != prompt) | (F.col("r.model") != model) | (F.col("r.prompt_hash") != prompt_hash)
    documents = runs.select("document_id").distinct()
    return documents.join(last, "document_id", "left").select("document_id", F.coalesce(differs, F.lit(True)).alias("stale"), F.coalesce(F.col("r.least_confidence") < JUDGED_BELOW, F.lit(False)).alias("judged"))


def append_absent(path: str, rows: DataFrame, keys: list[str]) -> int:
    """Append to a Parquet table the rows whose keys it lacks, the smallest of those with equal keys; how many were appended. Runs again without effect."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    best = rows.groupBy(*keys).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        best = best.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    beside = new_path(spark, "append")
    best.write.parquet(beside)
    new = spark.read.schema(rows.schema).parquet(beside)
    new.write.mode("append").parquet(path)
    return new.count()
