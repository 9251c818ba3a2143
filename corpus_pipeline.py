"""The corpus pipeline: five stages over `documents`, each with an operator of the llm subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import langid, neardup, packing, passages, quality
from parchment.llm.common import stash, stashed, sweep

#: Documents whose best profile is farther than this are in no language that was learned.
MIN_SCORE = 0.2
WORD_BPE = "word_bpe_49k.json"


def _row(docs: DataFrame) -> Column:
    """A row as one value, so that its columns may have any names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null, empty and blank texts do not. Equal rows are judged alike, very long texts as a whole; an empty table gives an
    empty one; further columns, of any names, and nulls in them, stay.
    """
    rows = docs.select(_row(docs), F.col("text").alias("text"))
    return quality.quality(rows, into="quality").filter("quality.kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones; those without letters, or far from every profile, go.

    So null and empty texts go, and all documents if none is labelled. Languages at equal distance: the first by name, which
    decides nothing here. Equal rows are judged alike, very long texts as a whole; an empty table gives an empty one; further
    columns, of any names, and nulls in them, stay.
    """
    rows = docs.select(_row(docs), F.col("text").alias("text"))
    found = langid.identify(rows, langid.train(docs.select("doc_id", "text", "lang")))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): the one with the smallest id.

    Null and empty texts are in no group and stay, as do rows with a null id. Rows that repeat an id are one document, and
    stay or go together. Very long texts count as a whole; an empty table gives an empty one; further columns, of any names, stay.
    """
    groups = neardup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def repeated_passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text. What is left empty goes.

    Null and empty texts, and rows with a null id, share nothing and stay. Rows that repeat an id are cut each by its own
    text's passages. Very long texts count as a whole; an empty table gives an empty one; further columns, of any names, stay.
    """
    out = passages.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences.

    A null or empty text is one piece, of the end id. Rows that repeat an id give pieces each; pieces of equal length go in
    row order. Very long texts are cut into pieces; an empty table gives an empty one; only doc_id and text are read.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path(WORD_BPE)))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicate_removal),
    ("substring dedup", repeated_passage_removal),
    ("best-fit packing", sequence_packing),
]

#: SQL cannot express language profiles, MinHash, chaining and token ids: tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each result is written to the shared folder and read again, and what it was made from is deleted."""
    older, docs = stashed(), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs)
            sweep(docs, older)
    return docs
