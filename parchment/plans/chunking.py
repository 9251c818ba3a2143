"""Segments, trees, chunks and batches. Lines of documents stand for paragraphs, turns for the items of a document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.chunking import batches, descendants, upper_median
from ..sources.tables import load
from .registry import query

_LINES = "select doc_id, generate_subscripts(string_split(text, chr(10)), 1) n, unnest(string_split(text, chr(10))) line from documents"


@query("""with d as (select distinct l_orderkey o, floor(l_extendedprice / 100) x from lineitem), g as (select *, x - lag(x) over (partition by o order by x) > 50 opens from d)
    select o, cast(x as bigint) x, cast(sum(case when opens then 1 else 0 end) over (partition by o order by x) as bigint) band from g""")
def p14_indent_bands(spark, sf_dir):
    """Bands of distinct values: a gap of more than 50 opens the next."""
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice").select(F.col("l_orderkey").alias("o"), F.floor(F.col("l_extendedprice") / 100).alias("x")).distinct()
    order = Window.partitionBy("o").orderBy("x")
    opens = F.when(F.col("x") - F.lag("x").over(order) > 50, 1).otherwise(0)
    return rows.withColumn("opens", opens).select("o", "x", F.sum("opens").over(order).alias("band"))


@query(f"""with l as ({_LINES}), s as (select doc_id, min(n) filter (regexp_matches(line, '^[0-9]+[.)] ')) start from l group by 1)
    select doc_id, count(*) filter (trim(line) = '') empty, count(*) filter (trim(line) <> '' and n < start) front, count(*) filter (trim(line) <> '' and (start is null or n >= start)) content from l join s using (doc_id) group by 1""")
def p18_segments(spark, sf_dir):
    """Lines before the first numbered one are the front; without one, nothing is removed. Lines stay inside their row: no shuffle."""
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x: x.rlike("^[0-9]+[.)] "))
    start = F.array_position(numbered, True)
    rows = load(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", lines.alias("lines"), start.alias("start"))
    solid = lambda test: F.size(F.filter("lines", lambda x, i: (F.trim(x) != "") & test(i + 1))).cast("long")
    return rows.select(
        "doc_id",
        F.size(F.filter("lines", lambda x: F.trim(x) == "")).cast("long").alias("empty"),
        solid(lambda n: n < F.col("start")).alias("front"),
        solid(lambda n: n >= F.col("start")).alias("content"),
    )


@query("select p_partkey, cast(dense_rank() over (partition by p_brand order by p_size) - 1 as integer) depth from part")
def p23_outline_ranks(spark, sf_dir):
    """Ranks over the levels in use. The levels of a group are few: they are ranked, and joined back."""
    rows = load(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    levels = rows.select("p_brand", "p_size").distinct().withColumn("depth", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size")) - 1)
    return rows.alias("a").join(levels.alias("b"), F.col("a.p_brand").eqNullSafe(F.col("b.p_brand")) & F.col("a.p_size").eqNullSafe(F.col("b.p_size"))).select("p_partkey", "depth")


@query("""with p as (select l_orderkey o, [l_returnflag, l_linestatus, cast(l_linenumber as varchar)] path from lineitem), n as (select distinct o, unnest([path[1:1], path[1:2], path]) path from p)
    select a.o, array_to_string(a.path, '/') path, len(a.path) as level, count(b.path) descendants, count(b.path) filter (len(b.path) = len(a.path) + 1) children
    from n a left join n b on a.o = b.o and len(b.path) > len(a.path) and b.path[1:len(a.path)] = a.path group by a.o, a.path""")
def c2_descendants(spark, sf_dir):
    """Children and descendants of each node of the trees order / flag / status / line."""
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    path = F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    nodes = rows.select(F.col("l_orderkey").alias("o"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.slice(path, F.lit(1), n))).alias("path")).distinct()
    out = descendants(nodes, "o")
    return out.select("o", F.array_join("path", "/").alias("path"), F.size("path").cast("long").alias("level"), "descendants", "children")


@query("""with c as (select conv_id, turn // 2 r, turn % 2 c, string_agg(coalesce(text, ''), ' ' order by text) t from conversations group by all), g as (select distinct conv_id, r from c), w as (select conv_id, max(c) m from c group by 1)
    select g.conv_id, g.r, md5(coalesce(max(t) filter (c = 0), '') || case when any_value(m) = 1 then ' | ' || coalesce(max(t) filter (c = 1), '') else '' end) line
    from g join w on g.conv_id = w.conv_id left join c on g.conv_id = c.conv_id and g.r = c.r group by g.conv_id, g.r""")
def c4_table_lines(spark, sf_dir):
    """Cells (row, column) as lines: columns joined with ` | `, empty ones kept, paragraphs of a cell joined by a space."""
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    at = rows.select("conv_id", F.expr("turn div 2").alias("r"), (F.col("turn") % 2).alias("c"), F.coalesce("text", F.lit("")).alias("text"))
    cells = at.groupBy("conv_id", "r", "c").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("t"))
    lines = cells.groupBy("conv_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "t"))).alias("m"))
    widths = cells.groupBy("conv_id").agg(F.max("c").alias("last"))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda c: F.coalesce(F.col("m")[c], F.lit(""))), " | ")
    return lines.join(widths, "conv_id").select("conv_id", "r", F.md5(line).alias("line"))


@query(f"""with l as (select doc_id, n, line from ({_LINES}) where trim(line) <> ''), c as (select doc_id, 0 n, 'macro' kind, string_agg(line, chr(10) order by n) t from l group by 1 union all select doc_id, n, 'micro', line from l)
    select doc_id, kind, cast(row_number() over (partition by doc_id order by n) as integer) as at, length(t) chars, md5(t) hash from c""")
def c11_chunks(spark, sf_dir):
    """A macro chunk of each document's lines, then a micro chunk of each line: emitted from the row itself, without a shuffle."""
    rows = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines")).filter(F.size("lines") > 0)
    out = rows.select("doc_id", F.posexplode(F.concat(F.array(F.array_join("lines", "\n")), F.col("lines"))).alias("at", "t"))
    return out.select("doc_id", F.when(F.col("at") == 0, "macro").otherwise("micro").alias("kind"), (F.col("at") + 1).alias("at"), F.length("t").cast("long").alias("chars"), F.md5("t").alias("hash"))


@query("""with r as (select source, n_chars, row_number() over (partition by source order by n_chars) - 1 i, count(*) over (partition by source) c from documents where n_chars is not null)
    select source, max(n_chars) filter (i = c // 2) as median, max(n_chars) longest, count(*) n from r group by 1""")
def c12_size_stats(spark, sf_dir):
    """Upper median (element n // 2 of the sorted sizes) and greatest size of each source."""
    return upper_median(load(spark, sf_dir, "documents", "source", "n_chars"), "source", "n_chars")


@query("""with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) i, greatest(1, length(text) // 4) + 12 cost from conversations where text is not null),
    b as (select conv_id, i, cost, cost used, 1 items, 0 batch from t where i = 1
    union all select t.conv_id, t.i, t.cost, case when items + 1 > 3 or used + t.cost > 150 then t.cost else used + t.cost end, case when items + 1 > 3 or used + t.cost > 150 then 1 else items + 1 end,
        case when items + 1 > 3 or used + t.cost > 150 then batch + 1 else batch end from b join t on t.conv_id = b.conv_id and t.i = b.i + 1)
    select conv_id, batch, count(*) items, cast(sum(cost) as bigint) tokens from b group by 1, 2""")
def m5_batches(spark, sf_dir):
    """Turns in order, at most 3 and 150 tokens a batch; a turn beyond that is a batch of its own."""
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("text is not null")
    cost = (F.greatest(F.lit(1), F.floor(F.length("text") / 4)) + 12).cast("long")
    return batches(rows.withColumn("cost", cost), "conv_id", ["turn", "role", "text"], "cost", most=150, items=3)
