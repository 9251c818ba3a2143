"""Labels and phrases in the form in which they are compared: lookups, and the scan of documents for a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.folding import exhibit_label, folded
from ..operators import phrases
from ..sources.tables import load
from .registry import query

#: folded() in SQL, for texts whose only letter that folds to two is ß.
_FOLD = "trim(regexp_replace(translate(replace(lower(nfc_normalize(coalesce({0}, ''))), 'ß', 'ss'), '‐‑‒–—−‘’“”', '------''''\"\"'), '[\\s\\x{{a0}}]+', ' ', 'g'))"
_TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]"
_WORD = "^[\\p{L}\\p{N}_]"

#: Every run of two and of three words of the benchmark items is a phrase; its key is the smallest item that has it.
_PHRASES = f"""t as (select item_id, regexp_extract_all({_FOLD.format('text')}, '{_TOKEN}') k from benchmark), r as (select item_id, k[i:i + m - 1] w from (select *, unnest(range(1, len(k) + 1)) i from t), (select unnest([3, 5]) m) where i + m - 1 <= len(k)),
    ph as materialized (select array_to_string(w, '') phrase, min(item_id) as key from r where w[2] = ' ' and coalesce(w[4], ' ') = ' ' and regexp_matches(w[1], '{_WORD}') and regexp_matches(w[3], '{_WORD}') and regexp_matches(coalesce(w[5], 'a'), '{_WORD}') group by 1)"""
_FOUND = f"""with recursive {_PHRASES}, d as (select doc_id, regexp_extract_all({_FOLD.format('text')}, '{_TOKEN}') k from documents),
    w as (select doc_id, unnest(k) w, generate_subscripts(k, 1) i from d),
    pos as materialized (select doc_id, i, w || lead(w) over o || lead(w, 2) over o a, w || lead(w) over o || lead(w, 2) over o || lead(w, 3) over o || lead(w, 4) over o b from w window o as (partition by doc_id order by i)),
    cand as materialized (select doc_id, i, max(n) n, arg_max(key, n) as key from (select doc_id, i, 5 n, key from pos join ph on b = phrase union all select doc_id, i, 3, key from pos join ph on a = phrase) group by 1, 2),
    nx as materialized (select c.*, (select min(e.i) from cand e where e.doc_id = c.doc_id and e.i >= c.i + c.n) nxt, row_number() over (partition by doc_id order by i) first from cand c),
    g as (select doc_id, i, key, nxt from nx where first = 1 union all select nx.doc_id, nx.i, nx.key, nx.nxt from g join nx on nx.doc_id = g.doc_id and nx.i = g.nxt)"""


def _benchmark_phrases(spark, sf_dir):
    word = F.lit(_WORD)
    tokens = load(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.regexp_extract_all(folded(F.col("text")), F.lit(_TOKEN), F.lit(0)).alias("k"))
    runs = tokens.select("item_id", F.posexplode("k").alias("i", "w"), "k").select("item_id", F.explode(F.array(*[F.when(F.col("i") + m <= F.size("k"), F.slice("k", F.col("i") + 1, m)) for m in (3, 5)])).alias("w"))
    spaced = F.forall("w", lambda x: x.rlike(_WORD) | (x == " ")) & F.rlike(F.col("w")[0], word) & F.rlike(F.col("w")[2], word) & (F.col("w")[1] == " ") & ((F.size("w") == 3) | (F.rlike(F.get("w", 4), word) & (F.get("w", 3) == " ")))
    return runs.filter("w is not null").filter(spaced).select(F.array_join("w", "").alias("phrase"), F.col("item_id").alias("key"))


@query(_FOUND + " select doc_id, array_to_string(list_sort(list_distinct(list(key))), ',') keys, count(*) n from g group by 1")
def m10_expected_keys(spark, sf_dir):
    """The benchmark items whose phrases each document holds: whole phrases, leftmost, longest first, without overlaps."""
    found = phrases.scan(load(spark, sf_dir, "documents", F.col("doc_id").alias("doc"), "text"), _benchmark_phrases(spark, sf_dir))
    per = found.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.col("doc").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"), F.sum("n").alias("n"))


@query(_FOUND + " select doc_id, key, count(*) n from g group by all")
def j15_phrase_join(spark, sf_dir):
    """Documents joined with the benchmark items of which they hold a phrase, by the same scan over a dictionary in several parts."""
    words = _benchmark_phrases(spark, sf_dir)
    found = phrases.scan(load(spark, sf_dir, "documents", F.col("doc_id").alias("doc"), "text"), words, part_phrases=1000)
    return found.groupBy(F.col("doc").alias("doc_id"), "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"select k, count(*) n, min(doc_id) first from (select doc_id, {_FOLD.format('line')} k from (select doc_id, unnest(string_split(text, chr(10))) line from documents)) where k <> '' group by 1")
def m7_folded_lines(spark, sf_dir):
    """Lines of all documents that are the same but for case, dashes, quotes and spaces."""
    lines = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", folded(F.col("line")).alias("k")).filter("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("""with v as (select case page_id % 5 when 0 then 'Exhibit ' || url when 1 then ' SCHEDULE: ' || url || 's' when 2 then 'Annex' when 3 then url else 'attachment -  ' || upper(url) end as v from pages),
    s as (select v, trim(lower(regexp_replace(regexp_replace(regexp_replace(trim(v), '(?i)^(exhibit|schedule|annex|appendix|attachment|addendum)\\s*', ''), '^[\\s:\\-–—]+', ''), '\\s+', ' ', 'g'))) k from v)
    select v, nullif(case when length(k) > 2 and k like '%s' then left(k, length(k) - 1) else k end, '') label from s group by all""")
def x3_exhibit_labels(spark, sf_dir):
    """Labels of exhibits in their form for grouping."""
    url, kind = F.col("url"), F.col("page_id") % 5
    v = F.when(kind == 0, F.concat(F.lit("Exhibit "), url)).when(kind == 1, F.concat(F.lit(" SCHEDULE: "), url, F.lit("s"))).when(kind == 2, "Annex").when(kind == 3, url).otherwise(F.concat(F.lit("attachment -  "), F.upper(url)))
    return load(spark, sf_dir, "pages", "page_id", "url").select(v.alias("v")).distinct().withColumn("label", exhibit_label(F.col("v")))


@query(f"""with vocabulary as (select {_FOLD.format('p_name')} k, min(p_partkey) part from part group by 1), said as (select o_orderkey, case o_orderkey % 4 when 0 then upper(p_name) when 1 then ' ' || replace(p_name, ' ', '  ') when 2 then p_name || 's' else p_name end label, o_orderstatus from orders join part on p_partkey = o_orderkey % (select count(*) from part))
    select o_orderkey, part from said left join vocabulary on k = {_FOLD.format('label')} and o_orderstatus <> 'P'""")
def m9_exact_lookup(spark, sf_dir):
    """Labels looked up in a vocabulary of folded names, where they apply; others find nothing."""
    part = load(spark, sf_dir, "part", "p_partkey", "p_name")
    vocabulary = part.groupBy(folded(F.col("p_name")).alias("k")).agg(F.min("p_partkey").alias("part"))
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumn("p", F.col("o_orderkey") % F.lit(part.count()))
    kind, name = F.col("o_orderkey") % 4, F.col("p_name")
    label = F.when(kind == 0, F.upper(name)).when(kind == 1, F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("  ")))).when(kind == 2, F.concat(name, F.lit("s"))).otherwise(name)
    said = orders.join(part, F.col("p") == F.col("p_partkey")).select("o_orderkey", F.when(F.col("o_orderstatus") != "P", folded(label)).alias("k"))
    return said.join(vocabulary, "k", "left").select("o_orderkey", "part")
