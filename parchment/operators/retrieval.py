"""Hybrid retrieval: keyword scores, vector similarity, and their fusion by reciprocal ranks."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: The keyword library's defaults, and the constant of rank fusion.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def bm25(docs: DataFrame, query: str, id: str, text: str) -> DataFrame:
    """(id, score) of every document, those that score zero included.

    A negative inverse document frequency becomes EPSILON times the mean over all terms. A word that the query holds
    twice counts twice. Two passes: one aggregate of document frequencies, whose row without a term holds the number of
    documents and of their words; then a projection of each document, without a shuffle. Null texts score zero.
    """
    asked = Counter(re.findall("[a-z]+", query.lower()))
    counted = docs.select(F.col(id).alias("id"), tokens(F.col(text)).alias("t"))
    terms = F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("t"), F.expr("cast(array() as array<string>)")))
    df = counted.select(F.size("t").alias("dl"), F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.avg("dl").alias("mean"))
    size = df.filter("term = ''").select(F.col("df").alias("n"), "mean")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = df.filter("term <> ''").select("term", "df").crossJoin(F.broadcast(size)).select("term", "mean", raw.alias("raw"))
    of_terms = [F.max(F.when(F.col("term") == t, F.col("raw"))).alias(f"raw_{t}") for t in asked]
    stats = idf.agg(F.first("mean").alias("mean"), F.avg("raw").alias("mean_idf"), *of_terms)  # one row
    parts = []
    for t, times in asked.items():
        weight = times * F.when(F.col(f"raw_{t}") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col(f"raw_{t}"))
        parts.append(F.coalesce(weight * F.col(f"tf_{t}") * (K1 + 1) / (F.col(f"tf_{t}") + K1 * (1 - B + B * F.col("dl") / F.col("mean"))), F.lit(0.0)))

    def count_of(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == term)).alias(f"tf_{term}")

    rows = counted.select("id", F.size("t").alias("dl"), *map(count_of, asked)).crossJoin(F.broadcast(stats))
    return rows.select("id", sum(parts, F.lit(0.0)).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(library: DataFrame, vector: DataFrame, id: str, column: str) -> DataFrame:
    """(id, score): cosine with the one row (q) of vector."""
    return library.crossJoin(F.broadcast(vector)).select(F.col(id).alias("id"), cosine(F.col(column), F.col("q")).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best (id, score) and their rank from 1; scores equal to 9 places tie, to the smaller id. Only k rows meet in one task."""
    order = [F.desc(F.round("score", 9)), F.col("id")]
    return scores.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(by_meaning: DataFrame, by_words: DataFrame, k: int) -> DataFrame:
    """Reciprocal ranks of two ranked lists summed; a side without the row gives 0."""
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    a = by_meaning.select("id", F.col("score").alias("dense_score"), F.col("rank").alias("dr"))
    b = by_words.select("id", F.col("score").alias("bm25_score"), F.col("rank").alias("br"))
    both = a.join(b, "id", "full_outer").withColumn("rrf", part("dr") + part("br"))
    found = F.when(F.col("dr").isNotNull() & F.col("br").isNotNull(), "both").when(F.col("dr").isNotNull(), "meaning").otherwise("keywords")
    out = both.select("id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "rrf", found.alias("found_by"))
    return out.orderBy(F.desc("rrf"), "id").limit(k)
