"""Hybrid retrieval over documents and embeddings (vec_id stands for doc_id)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import band, tokens
from ..operators import retrieval as R
from ..operators.fallback import kept
from ..sources.tables import load
from .registry import query

QUERY, TOP, VECTOR = "the and of with ringing the", 10, 7

_TOK = "regexp_extract_all(lower(text), '[a-z]+')"
_BM25 = f"""
    d as (select doc_id id, {_TOK} t from documents),
    sz as (select count(*) n, avg(len(t)) mean from d),
    idf as (select term, ln(n - df + 0.5) - ln(df + 0.5) raw from (select term, count(*) df from (select unnest(list_distinct(t)) term from d) group by 1), sz),
    asked as (select term, count(*) times from (select unnest({_TOK}) term from (select '{QUERY}' as text)) group by 1),
    w as (select term, times * case when raw < 0 then 0.25 * (select avg(raw) from idf) else raw end w from idf join asked using (term)),
    tf as (select id, dl, term, w, count(*) tf from (select id, len(t) dl, unnest(t) term from d) join w using (term) group by all),
    sc as (select id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) score from tf, sz group by 1),
    bm as (select d.id, coalesce(score, 0) score from d left join sc using (id))"""
_DENSE = f"""
    qv as (select embedding q from embeddings where vec_id = {VECTOR}),
    dn as (select vec_id id, label, list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::double * p[2]::double))
        / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q, lambda x: x::double * x::double)))) score from embeddings, qv)"""
_LISTS = f"""
    dr as (select *, row_number() over (order by round(score, 9) desc, id) r from dn order by round(score, 9) desc, id limit {2 * TOP}),
    br as (select *, row_number() over (order by round(score, 9) desc, id) r from bm order by round(score, 9) desc, id limit {3 * TOP}),
    fused as (select coalesce(dr.id, br.id) id, coalesce(dr.score, 0) dense_score, coalesce(br.score, 0) bm25_score,
        coalesce(1.0::double / (60 + dr.r), 0) + coalesce(1.0::double / (60 + br.r), 0) rrf,
        case when dr.id is not null and br.id is not null then 'both' when dr.id is not null then 'meaning' else 'keywords' end found_by
        from dr full join br on dr.id = br.id order by rrf desc, id limit {TOP})"""


def _vector(spark, sf_dir):
    """One row, though the id be repeated."""
    return load(spark, sf_dir, "embeddings").filter(F.col("vec_id") == VECTOR).select(F.col("embedding").alias("q")).limit(1)


def _lists(spark, sf_dir):
    by_meaning = R.top(R.dense(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), "vec_id", "embedding"), 2 * TOP)
    by_words = R.top(R.bm25(load(spark, sf_dir, "documents", "doc_id", "text"), QUERY, "doc_id", "text"), 3 * TOP)
    return by_meaning, by_words


@query(f"with {_DENSE} select id, round(score, 6) score, cast(row_number() over (order by round(score, 9) desc, id) as integer) rank from dn order by round(score, 9) desc, id limit {2 * TOP}")
def v2_dense_top_k(spark, sf_dir):
    return R.top(R.dense(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), "vec_id", "embedding"), 2 * TOP).withColumn("score", F.round("score", 6))


@query(f"with {_BM25} select id, round(score, 6) score from bm")
def v3_bm25(spark, sf_dir):
    return R.bm25(load(spark, sf_dir, "documents", "doc_id", "text"), QUERY, "doc_id", "text").withColumn("score", F.round("score", 6))


@query(f"with {_BM25}, {_DENSE}, {_LISTS} select id, round(dense_score, 6) dense_score, round(bm25_score, 6) bm25_score, round(rrf, 8) rrf, found_by from fused")
def v4_hybrid_rrf(spark, sf_dir):
    out = R.fuse(*_lists(spark, sf_dir), TOP)
    return out.select("id", F.round("dense_score", 6).alias("dense_score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("rrf", 8).alias("rrf"), "found_by")


@query(f"""with {_BM25}, {_DENSE}, {_LISTS} select id, round(dense_score, 4) confidence,
    case when dense_score >= 0.72 then 'high' when dense_score >= 0.55 then 'moderate' else 'low' end quality, dense_score < 0.5 blindspot from fused order by rrf desc, id limit 1""")
def v7_verdict(spark, sf_dir):
    """The best fused hit; found by keywords only, its confidence is 0."""
    best = R.fuse(*_lists(spark, sf_dir), TOP).orderBy(F.desc("rrf"), "id").limit(1)
    return best.select("id", F.round("dense_score", 4).alias("confidence"), band(F.col("dense_score")).alias("quality"), (F.col("dense_score") < 0.5).alias("blindspot"))


@query(f"""with asked as (select list_distinct(list_filter({_TOK}, lambda x: len(x) > 3)) q from (select '{QUERY}' as text)),
    d as (select doc_id, list_distinct(list_filter({_TOK}, lambda x: len(x) > 3)) t from documents)
    select doc_id, round(least(0.65, 1.5 * len(list_intersect(t, q)) / nullif(len(list_distinct(list_concat(t, q))), 0)), 6) score from d, asked""")
def v5_keyword_fallback(spark, sf_dir):
    """Jaccard of words longer than 3 letters, times 1.5, 0.65 at most."""
    long_words = lambda c: F.array_distinct(F.filter(tokens(c), lambda x: F.length(x) > 3))
    t, q = long_words(F.col("text")), long_words(F.lit(QUERY))
    union = F.size(F.array_union(t, q))
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(F.least(F.lit(0.65), 1.5 * F.size(F.array_intersect(t, q)) / F.when(union > 0, union)), 6).alias("score"))


@query("""select label, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 1) pct from embeddings group by label""")
def v10_collection_statistics(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings", "label")
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query(f"""with {_DENSE}, t as (select *, row_number() over (partition by label order by round(score, 9) desc, id) r from dn)
    select label, count(*) n, round(avg(score), 6) top3 from t where r <= 3 group by label""")
def a20_top3_average(spark, sf_dir):
    """Mean of the three best similarities of each label; top lists are merged by aggregates, no label is ordered as a whole."""
    scored = load(spark, sf_dir, "embeddings").crossJoin(F.broadcast(_vector(spark, sf_dir))).select("label", R.cosine(F.col("embedding"), F.col("q")).alias("score"), "vec_id")
    salted = scored.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    three = lambda rows, *keys: rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter("r <= 3").drop("r")
    best = three(three(salted, "label", "part"), "label")
    return best.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("top3"))


@query("""with a as (select vec_id, label, embedding from embeddings), a1 as (select * from a where label = 2 or not exists (select 1 from a where label = 2)), a2 as (select * from a1 where vec_id > 1000000000 or not exists (select 1 from a1 where vec_id > 1000000000)),
    a3 as (select * from a2 where vec_id % 5 = 1 or not exists (select 1 from a2 where vec_id % 5 = 1)) select vec_id, label from a3""")
def f6_fallback_filters(spark, sf_dir):
    """Three filters of a library of which the second would leave nothing, and gives way."""
    rows = load(spark, sf_dir, "embeddings", "vec_id", "label")
    return kept(rows, F.col("label") == 2, F.col("vec_id") > 1_000_000_000, F.col("vec_id") % 5 == 1)


_SHOWN = f"""with {_BM25}, {_DENSE}, {_LISTS}, hits as (select *, row_number() over (order by rrf desc, id) rank from fused order by rrf desc, id limit 5),
    long_asked as (select list_distinct(list_filter({_TOK}, lambda x: len(x) > 3)) q from (select '{QUERY}' as text)), m as (select hits.*, d.text, d.lang, d.source from hits join documents d on d.doc_id = hits.id)"""


def _hits(spark, sf_dir):
    """The five best, by rank, with what the library holds of them."""
    best = R.fuse(*_lists(spark, sf_dir), TOP).orderBy(F.desc("rrf"), "id").limit(5).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), "id")))
    return best.join(load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), F.col("id") == F.col("doc_id"))


@query(_SHOWN + f""" select cast(rank as integer) rank, id, lang, source, round(dense_score, 4) similarity, round(rrf, 6) rrf, found_by,
    array_to_string(list_transform(list_sort(list_transform(list_intersect(list_distinct(list_filter({_TOK}, lambda x: len(x) > 3)), q), lambda w: {{'n': -len(w), 'w': w}})), lambda s: s.w)[1:10], ',') shared from m, long_asked""")
def v8_library_matches(spark, sf_dir):
    """The five best hits with the words that they share with the query: longest first, then by letters, ten at most (O8)."""
    long_words = lambda c: F.array_distinct(F.filter(tokens(c), lambda x: F.length(x) > 3))
    shared = F.array_intersect(long_words(F.col("text")), long_words(F.lit(QUERY)))
    ordered = F.transform(F.sort_array(F.transform(shared, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
    return _hits(spark, sf_dir).select("rank", "id", "lang", "source", F.round("dense_score", 4).alias("similarity"), F.round("rrf", 6).alias("rrf"), "found_by", F.array_join(F.slice(ordered, 1, 10), ",").alias("shared"))


@query(_SHOWN + """, c as (select lang from m where rank = 1), s as (select round(dense_score, 4) top from m where rank = 1)
    select c.lang canonical, count(*) filter (d.lang = c.lang) n, round(100.0::double * count(*) filter (d.lang = c.lang) / count(*), 1) pct, count(distinct d.source) filter (d.lang = c.lang) spread, count(distinct d.source) sources, count(*) library, any_value(s.top) top,
    (select round(avg(round(round(dense_score, 4), 3)), 3) from m where rank <= 3) top3, case when any_value(s.top) >= 0.72 then 'high' when any_value(s.top) >= 0.55 then 'moderate' else 'low' end band from documents d, c, s group by c.lang""")
def v9_coverage(spark, sf_dir):
    """How well the whole library, without filters, covers the best hit's kind, and how good the hits are."""
    hits = _hits(spark, sf_dir)
    best = hits.agg(F.max(F.when(F.col("rank") == 1, F.col("lang"))).alias("canonical"), F.max(F.when(F.col("rank") == 1, F.round("dense_score", 4))).alias("top"), F.round(F.avg(F.when(F.col("rank") <= 3, F.round(F.round("dense_score", 4), 3))), 3).alias("top3"))
    mine = F.col("lang") == F.col("canonical")
    rows = load(spark, sf_dir, "documents", "lang", "source").crossJoin(F.broadcast(best))
    out = rows.groupBy("canonical", "top", "top3").agg(F.count_if(mine).alias("n"), F.count(F.lit(1)).alias("library"), F.count_distinct(F.when(mine, F.col("source"))).alias("spread"), F.count_distinct("source").alias("sources"))
    return out.select("canonical", "n", F.round(100.0 * F.col("n") / F.col("library"), 1).alias("pct"), "spread", "sources", "library", "top", "top3", band(F.col("top")).alias("band"))


@query(_SHOWN + " select 'lang' kind, coalesce(nullif(lang, ''), 'Unspecified') as name, count(*) n from m group by all union all select 'source', coalesce(nullif(source, ''), 'Unspecified'), count(*) from m group by all")
def a21_matched_distributions(spark, sf_dir):
    """Kinds and sources among the five best hits."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unspecified")).alias("name")) for c in ("lang", "source")]))
    return _hits(spark, sf_dir).select(kinds.alias("k")).select("k.*").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DENSE}, dr as (select *, row_number() over (order by round(score, 9) desc, id) r from dn) select id, round(score, 6) dense_score, 0.0::double bm25_score, round(1.0::double / (60 + r), 8) rrf, 'meaning' found_by from dr where r <= {TOP}")
def v6_dense_only(spark, sf_dir):
    """What is shown where the keyword side is not there: vector hits alone, in the form of fused ones."""
    hits = R.top(R.dense(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), "vec_id", "embedding"), TOP)
    return hits.select("id", F.round("score", 6).alias("dense_score"), F.lit(0.0).alias("bm25_score"), F.round(1.0 / (R.RRF_K + F.col("rank")), 8).alias("rrf"), F.lit("meaning").alias("found_by"))
