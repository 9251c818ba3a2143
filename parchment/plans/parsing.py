"""Number formats and scalar functions by their exact rules, on values of the supplied tables, and a few joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.tables import load
from .derived import derived, derived_sql
from .registry import query

def _letters_sql(n: str) -> str:
    return " || ".join(f"case when {n} >= {(26**k - 1) // 25} then chr(cast(97 + (({n} - {(26**k - 1) // 25}) // {26 ** (k - 1)}) % 26 as integer)) else '' end" for k in range(6, 0, -1))


@query(f"""with x as (select o_orderkey - 1 n, case o_orderpriority when '1-URGENT' then 'decimalZero' when '2-HIGH' then 'lowerLetter' when '3-MEDIUM' then 'upperLetter' when '5-LOW' then 'lowerRoman' else case o_orderstatus when 'F' then 'upperRoman' when 'O' then 'none' else 'other' end end form from orders),
    y as (select *, {_letters_sql('n')} l, case when n > 0 then repeat('m', cast(n // 1000 as integer)) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][(n // 100) % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][(n // 10) % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] else '' end r from x)
    select n, form, case form when 'decimalZero' then case when n between 0 and 9 then '0' || n else n::varchar end when 'lowerLetter' then l when 'upperLetter' then upper(l) when 'lowerRoman' then r when 'upperRoman' then upper(r) when 'none' then '' else n::varchar end shown from y""")
def p17_number_formats(spark, sf_dir):
    """Order numbers in the number formats of a word processor."""
    low = F.when(F.col("o_orderstatus") == "F", "upperRoman").when(F.col("o_orderstatus") == "O", "none").otherwise("other")
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "decimalZero").when(F.col("o_orderpriority") == "2-HIGH", "lowerLetter").when(F.col("o_orderpriority") == "3-MEDIUM", "upperLetter").when(F.col("o_orderpriority") == "5-LOW", "lowerRoman").otherwise(low)
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select((F.col("o_orderkey") - 1).alias("n"), form.alias("form"))
    return rows.withColumn("shown", numbers.formatted(F.col("n"), F.col("form")))


@query(derived_sql("chunk_ids") + ", v as (select distinct v from chunk_ids)" + r" select v, nullif(regexp_extract(v, '^chunk_(.+)_([a-z]+)$', 1), '') id, nullif(regexp_extract(v, '^chunk_(.+)_([a-z]+)$', 2), '') kind from v")
def x9_local_ids(spark, sf_dir):
    """The clause id and kind of a chunk's local id."""
    part = lambda k: F.nullif(F.regexp_extract("v", r"^chunk_(.+)_([a-z]+)$", k), F.lit(""))
    return derived(spark, sf_dir, "chunk_ids").distinct().select("v", part(1).alias("id"), part(2).alias("kind"))


@query(derived_sql("trails") + ", v as (select distinct v from trails)" + " select v, len(string_split(v, ' > ')) crumbs, string_split(v, ' > ')[-1] last from v")
def x10_breadcrumbs(spark, sf_dir):
    """Parts of a breadcrumb."""
    parts = F.split("v", " > ")
    return derived(spark, sf_dir, "trails").distinct().select("v", F.size(parts).cast("long").alias("crumbs"), F.element_at(parts, -1).alias("last"))


@query("select doc_id, length(coalesce(text, '')) chars, len(regexp_extract_all(coalesce(text, ''), '\\S+')) words from documents")
def x12_word_and_char_counts(spark, sf_dir):
    """Characters and words of each document."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("chars"), F.size(F.regexp_extract_all("t", F.lit(r"\S+"), F.lit(0))).cast("long").alias("words"))


@query(derived_sql("answered") + ", v as (select distinct v from answered)" + r" select v, case when contains(v, '{') then regexp_extract(v, '(?s)(\{.*\})', 1) end json from v")
def x13_outermost_json(spark, sf_dir):
    """The outermost JSON object of an answer, without a fence around it."""
    return derived(spark, sf_dir, "answered").distinct().select("v", F.when(F.contains("v", F.lit("{")), F.regexp_extract("v", r"(?s)(\{.*\})", 1)).alias("json"))


@query(derived_sql("params") + ", v as (select distinct v from params)" + " select v, case when lower(trim(v)) in ('1', 'true', 'yes') then true when lower(trim(v)) in ('0', 'false', 'no') then false end b from v")
def x35_bool_params(spark, sf_dir):
    """1/true/yes, 0/false/no, else null."""
    low = F.lower(F.trim("v"))
    return derived(spark, sf_dir, "params").distinct().select("v", F.when(low.isin("1", "true", "yes"), True).when(low.isin("0", "false", "no"), False).alias("b"))


@query(derived_sql("ids") + ", v as (select distinct v from ids)" + " select v, regexp_matches(v, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') ok from v")
def x34_uuids(spark, sf_dir):
    """Whether a value is a UUID."""
    return derived(spark, sf_dir, "ids").distinct().select("v", F.rlike("v", F.lit("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")).alias("ok"))


@query(derived_sql("params") + ", v as (select distinct v from params)" + " select v, case when v = '' then 50 when regexp_matches(v, '^ *([0-9]+|-0+) *$') then least(cast(trim(v) as bigint), 200) end n from v")
def f3_integer_params(spark, sf_dir):
    """A limit: 50 if blank, at most 200, null (an error) if negative or no number."""
    n = F.expr("try_cast(trim(v) as bigint)")
    return derived(spark, sf_dir, "params").distinct().select("v", F.when(F.col("v") == "", 50).when(n >= 0, F.least(n, F.lit(200))).cast("long").alias("n"))


@query(derived_sql("params") + ", v as (select distinct v from params)" + " select v, case when starts_with(v, '[') then len(from_json(v, '[\"VARCHAR\"]')) when v = '' then 0 else 1 end n from v")
def x36_lists(spark, sf_dir):
    """Entries of a delimited parameter: a JSON array, else a single value."""
    rows = derived(spark, sf_dir, "params").distinct().withColumn("list", F.when(F.startswith("v", F.lit("[")), F.from_json("v", "array<string>")).when(F.col("v") == "", F.expr("cast(array() as array<string>)")).otherwise(F.array("v")))
    return rows.select("v", F.size("list").cast("long").alias("n"))


@query(derived_sql("times") + ", v as (select distinct v from times)" + " select v, case when regexp_matches(v, '([+-][0-9]{2}:[0-9]{2}|Z)$') then epoch_ms(try_cast(v as timestamptz)) when regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') then epoch_ms(try_cast(v as timestamp)) end ms from v")
def x24_iso_times(spark, sf_dir):
    """ISO-8601 times in milliseconds; without a zone they are UTC."""
    zoned = F.when(F.rlike("v", F.lit("([+-][0-9]{2}:[0-9]{2}|Z)$")), F.col("v")).otherwise(F.concat("v", F.lit("Z")))
    return derived(spark, sf_dir, "times").distinct().select("v", F.when(F.rlike("v", F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}T")), F.unix_millis(F.try_to_timestamp(zoned))).alias("ms"))


@query(derived_sql("names") + ", v as (select distinct v from names)" + r", s as (select v, left(regexp_replace(regexp_replace(v, '[^A-Za-z0-9._ -]+', '_', 'g'), '\.docx$', ''), 40) s from v) select v, coalesce(nullif(trim(s, ' ._'), ''), 'document') || '__' || left(md5(v), 8) dir from s")
def k10_export_dirs(spark, sf_dir):
    """A document's export folder: its name with other signs as `_`, without .docx, 40 characters at most, then eight of its id."""
    # Fixed value: the characters that a folder's name keeps.
    clean = F.regexp_replace(F.regexp_replace("v", r"[^A-Za-z0-9._ \-]+", "_"), r"\.docx$", "")
    stem = F.btrim(F.substring(clean, 1, 40), F.lit(" ._"))
    return derived(spark, sf_dir, "names").distinct().select("v", F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit("__"), F.substring(F.md5("v"), 1, 8)).alias("dir"))


@query(derived_sql("names") + ", v as (select distinct v from names)" + ", n as (select v, lower(trim(v)) k from v) select k, min(v) v from n where k <> '' group by 1")
def f34_queue_by_name(spark, sf_dir):
    """One entry for each lower-cased trimmed name."""
    return derived(spark, sf_dir, "names").distinct().withColumn("k", F.lower(F.trim("v"))).filter("k <> ''").groupBy("k").agg(F.min("v").alias("v"))


@query("select user_id, event_id, event_type, cast(ts as date) as day, rank from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rank from events) where rank <= 3")
def o9_latest_events(spark, sf_dir):
    """The last three events of each user."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("user_id", "event_id", "event_type", F.to_date("ts").alias("day"), "rank")


@query("select c_mktsegment, string_agg(n_name, ',' order by seen) names from (select c_mktsegment, n_name, min(c_custkey) seen from customer join nation on c_nationkey = n_nationkey group by 1, 2) group by 1")
def u8_distinct_in_order(spark, sf_dir):
    """Distinct nations of each segment, in the order in which customers name them first."""
    a, b = load(spark, sf_dir, "customer", "c_mktsegment", "c_nationkey", "c_custkey"), load(spark, sf_dir, "nation", "n_nationkey", "n_name")
    seen = a.groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("seen")).join(b, F.col("c_nationkey") == F.col("n_nationkey"))
    return seen.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seen", "n_name"))), lambda x: x["n_name"]), ",").alias("names"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def j9_without_any(spark, sf_dir):
    """Customers none of whose orders is finished, those without orders among them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def j10_never_labelled(spark, sf_dir):
    """Documents that no label names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(labels, "doc_id", "left_anti")
