"""Text functions, file gates, numbering and token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import load
from .registry import query

_LINES = "select doc_id, generate_subscripts(string_split(text, chr(10)), 1) n, unnest(string_split(text, chr(10))) line from documents"


@query("select doc_id, cast(len(regexp_extract_all(lower(text), '[a-z]+')) as integer) n_tokens, length(text) chars from documents".replace("length(text) chars", "cast(length(text) as integer) chars"))
def x2_token_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.length("text").alias("chars"))


@query("select doc_id, case when trim(source) in ('', 'null', 'None') then null else trim(source) end source from documents")
def x4_blank_to_null(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id", "source").select("doc_id", T.blank_to_null(F.col("source")).alias("source"))


@query("""with s as (select conv_id, turn, string_split(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), ' ') w from conversations)
    select conv_id, turn, array_to_string(w[1:15], ' ') || case when len(w) > 15 then ' ...' else '' end preview from s""")
def x6_preview(spark, sf_dir):
    return load(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", T.preview(F.col("text")).alias("preview"))


@query("select doc_id, md5(text) md5, sha256(text) sha256 from documents")
def x17_hashes(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("select conv_id, turn, greatest(1, length(text) // 4) tokens from conversations")
def m1_token_estimate(spark, sf_dir):
    return load(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("""select page_id, case when lower(ltrim(substr(html, 1, 64))) like '<!doctype html%' or lower(ltrim(substr(html, 1, 64))) like '<html%' then 'html' when lower(ltrim(substr(html, 1, 64))) like '%pdf%' then 'pdf' when lower(ltrim(substr(html, 1, 64))) like '<?xml%' then 'xml' else 'unknown' end kind from pages""")
def p1_file_kind(spark, sf_dir):
    return load(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.file_kind(F.col("html")).alias("kind"))


@query(f"""select doc_id, count(*) n_lines, count(*) filter (regexp_matches(line, '^[0-9]+[.)] ')) numbered, count(*) filter (trim(line) = '') empty, count(*) filter (line like '%:') lead_ins from ({_LINES}) group by 1""")
def p13_typed_numbers(spark, sf_dir):
    """Lines of each document that start with a typed number, are empty, or lead in a list."""
    line = lambda test: F.size(F.filter(F.split("text", "\n"), test)).cast("long")
    return load(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", line(lambda x: F.lit(True)).alias("n_lines"), line(lambda x: x.rlike("^[0-9]+[.)] ")).alias("numbered"), line(lambda x: F.trim(x) == "").alias("empty"), line(lambda x: x.endswith(":")).alias("lead_ins")
    )


@query(f"select doc_id, count(*) bad from (select doc_id, string_agg(replace(line, ' ', ''), '' order by n) joined, any_value(replace(replace(text, chr(10), ''), ' ', '')) whole from ({_LINES}) join documents using (doc_id) group by 1) where joined <> whole group by 1")
def p12_conservation(spark, sf_dir):
    """Documents whose split lines lose a character: none."""
    rows = load(spark, sf_dir, "documents", "doc_id", "text")
    joined = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.replace(x, F.lit(" "), F.lit(""))), "")
    whole = F.replace(F.replace("text", F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))
    return rows.filter(joined != whole).select("doc_id").groupBy("doc_id").agg(F.count("*").alias("bad"))
