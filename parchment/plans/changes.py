"""Changes of keyed tables, trees of folders, paragraphs cut into clauses, and differences of nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import inline
from ..operators import diffs
from ..operators.keyed_table import KeyedTable
from ..sources.shared import new_path
from ..sources.tables import load
from .derived import derived, derived_sql
from .registry import query

_LATEST = "select o_custkey, o_orderkey, o_totalprice from orders where o_orderstatus = '{0}' qualify row_number() over (partition by o_custkey order by o_orderkey desc, o_totalprice desc) = 1"
_FINAL = f"""with a as ({_LATEST.format('F')}), b as ({_LATEST.format('O')}), gone as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'),
    ab as (select * from b union all select * from a where o_custkey not in (select o_custkey from b))"""


def _changed(spark, sf_dir):
    """A table by customer: their newest finished order, then their newest open one, then without some customers; each change is run twice."""
    orders = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    rows = orders.select("o_custkey", "o_orderkey", "o_totalprice")
    table = KeyedTable(spark, new_path(spark, "keyed"), rows.schema, "o_custkey", buckets=8)
    done = []
    for status in ("F", "O"):
        batch = orders.filter(F.col("o_orderstatus") == status).select(*rows.columns)
        done += [(f"upsert {status}", table.upsert(batch)), (f"upsert {status} again", table.upsert(batch))]
    gone = orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    done += [("delete", table.delete(gone)), ("delete again", table.delete(gone))]
    return table, done


@query(_FINAL + " select * from ab where o_custkey not in (select o_custkey from gone)")
def k11_keyed_upsert(spark, sf_dir):
    """The contents of a table by key after two upserts and a delete, each of them run twice."""
    return _changed(spark, sf_dir)[0].read()


@query(_FINAL + """, n as (select (select count(*) from a) a, (select count(*) from b) b, (select count(*) from a join b using (o_custkey)) both_, (select count(*) from ab) ab, (select count(*) from ab join gone using (o_custkey)) g)
    select unnest(['upsert F', 'upsert F again', 'upsert O', 'upsert O again', 'delete', 'delete again']) step, unnest([a, 0, b - both_, 0, 0, 0]) added, unnest([0, 0, both_, 0, 0, 0]) updated, unnest([0, a, 0, b, 0, 0]) unchanged, unnest([0, 0, 0, 0, g, 0]) deleted, unnest([a, a, ab, ab, ab - g, ab - g]) total from n""")
def k12_change_counts(spark, sf_dir):
    """What each upsert and delete of the keyed table changed; the second run of each changes nothing."""
    rows = [(name, c.added, c.updated, c.unchanged, c.deleted, c.total) for name, c in _changed(spark, sf_dir)[1]]
    return spark.createDataFrame(rows, "step string, added long, updated long, unchanged long, deleted long, total long")


_WALK = "t as (select id, cast(id as string) as path, 1 as depth, name from folders where parent is null union all select f.id, t.path || '/' || f.id, t.depth + 1, f.name from t join folders f on f.parent = t.id where not contains('/' || t.path || '/', '/' || f.id || '/'))"


def _walk(spark, sf_dir, last):
    # A walk has as many rows as there are folders; the limit is there for recursions that never end, which the visited path rules out.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    return _recursive(spark, sf_dir, f"{_WALK}{last}")


def _recursive(spark, sf_dir, rest):
    text = f"with recursive folders as (select * from {{folders_}}), {rest}"
    frames = {"folders_": derived(spark, sf_dir, "folders")} | ({"files": derived(spark, sf_dir, "files")} if "{files}" in rest else {})
    return spark.sql(text, **frames)


@query(derived_sql("folders") + f", {_WALK} select id, path, depth, name from t")
def s3_folder_tree(spark, sf_dir):
    """Every folder with its path, by a recursion of any depth that does not enter a folder twice on one path."""
    return _walk(spark, sf_dir, " select id, path, depth, name from t")


@query(derived_sql("folders", "files") + f", {_WALK}, l as (select f.id, f.size, t.path from t join files f on f.parent = t.id) select id, max_by(size, path) size, max(path) path, count(*) listed from l group by id")
def s5_flattened_files(spark, sf_dir):
    """The files of all folders by id; of those listed several times, the last in the order of the walk."""
    return _walk(spark, sf_dir, ", l as (select f.id, f.size, t.path from t join {files} f on f.parent = t.id) select id, max_by(size, path) as size, max(path) as path, count(*) as listed from l group by id")


_Q = "\"''‘’“”"
_NUM = r"(?:\d{1,3}(?:\.\d{1,3})+\.?(?:\s+|[" + _Q + r"(])|(?:SECTION|Section|ARTICLE|Article|CLAUSE|Clause)\s+(?:\d{1,3}(?:\.\d{1,3})*|[IVXLC]{1,6})(?:\([A-Za-z0-9]{1,3}\))?\.?\s+)"


@query(derived_sql("paragraphs") + rf""", m as (select doc, ord, text, string_split(regexp_replace(text, '([.:;!?][{_Q})\]]?\s+)({_NUM})', '\1' || chr(30) || '\2', 'g'), chr(30)) p from paragraphs),
    u as (select doc, ord, length(text) n, generate_subscripts(p, 1) i, unnest(p) piece from m), s as (select *, sum(length(piece)) over (partition by doc, ord order by i) - length(piece) start, ltrim(regexp_replace(piece, '^{_NUM}', '')) rest from u),
    a as (select *, trim(regexp_extract(rest, '^([^.:\n]{{1,80}})[.:]', 1)) phrase from s), w as (select *, string_split_regex(phrase, '\s+') ws, list_filter(string_split_regex(phrase, '\s+'), lambda x: regexp_matches(x, '^[A-Za-z]')) named from a),
    c as (select *, i > 1 and start >= 25 and n - start >= 25 and (regexp_matches(piece, '^[^{_Q}]*[{_Q}][^{_Q}]{{1,60}}[{_Q}]') and regexp_matches(rest, '^[{_Q}]') or phrase <> '' and len(ws) <= 8 and (phrase = upper(phrase) or len(named) > 0 and len(list_filter(named, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.75 * len(named))) opens from w),
    g as (select *, sum(opens::integer) over (partition by doc, ord order by i) seg from c) select doc, ord, cast(seg as integer) seg, trim(string_agg(piece, '' order by i)) piece from g group by doc, ord, seg""")
def p11_inline_clauses(spark, sf_dir):
    """Paragraphs with the clauses that they hold, by a lateral join with a table function."""
    inline.register(spark)
    return spark.sql("select p.doc, p.ord, s.seg, trim(s.piece) as piece from {p} p, lateral split_inline(p.text) s", p=derived(spark, sf_dir, "paragraphs"))


@query(derived_sql("paragraphs") + " select count(*) n, 0::bigint changed from paragraphs")
def p12_split_conservation(spark, sf_dir):
    """Paragraphs, and those whose pieces, without white space, are not the paragraph."""
    inline.register(spark)
    rows = derived(spark, sf_dir, "paragraphs")
    solid = lambda c: F.regexp_replace(c, r"\s+", "")
    pieces = spark.sql("select p.doc, p.ord, s.seg, s.piece from {p} p, lateral split_inline(p.text) s", p=rows)
    joined = pieces.groupBy("doc", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "piece"))), lambda x: x["piece"]), "").alias("joined"))
    both = rows.join(joined, ["doc", "ord"], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~solid(F.col("text")).eqNullSafe(solid(F.col("joined")))).alias("changed"))


@query(derived_sql("states") + """, f as (select doc, n, unnest([{'p': 'k', 'v': json_extract(state, '$.k')}, {'p': 'type', 'v': json_extract(state, '$.type')}, {'p': 'gone', 'v': json_extract(state, '$.gone')}, {'p': 'at', 'v': case when json_type(state, '$.at') <> 'OBJECT' then json_extract(state, '$.at') end},
        {'p': 'at.v', 'v': json_extract(state, '$.at.v')}, {'p': 'at.deep.x', 'v': json_extract(state, '$.at.deep.x')}]) x from states), g as (select doc, n, x.p path, replace(x.v::varchar, ' ', '') v from f where x.v is not null),
    h as (select coalesce(b.doc, a.doc) doc, coalesce(b.n, a.n + 1) n, coalesce(b.path, a.path) path, a.v "from", b.v "to" from g a full join g b on a.doc = b.doc and a.n + 1 = b.n and a.path = b.path where a.v is distinct from b.v)
    select doc, n, path, "from", "to" from h where n > 1 and n <= (select max(n) from states s where s.doc = h.doc)""")
def x31_state_changes(spark, sf_dir):
    """What each event changed in its user's record: fields added, removed and changed at any depth, unknown ones too (X30, X32)."""
    return diffs.changes(derived(spark, sf_dir, "states"))


@query(derived_sql("states") + ", s as (select *, lag(state) over (partition by doc order by n) before from states) select doc, n from s where n > 1 and state is distinct from before")
def x31_changed_states(spark, sf_dir):
    """The events that changed something; each has one object {field: {from, to}}."""
    return diffs.as_json(diffs.changes(derived(spark, sf_dir, "states"))).filter("from_json(changes, 'map<string,string>') is not null").select("doc", "n")


#: Folders that a snapshot asks for, in order; one is named twice, one lies inside of another.
_ASKED = "asked as (select id, min(turn) as turn from (values ('n3', 1), ('r1', 2), ('n3', 3), ('c5', 4), ('nowhere', 5)) as v(id, turn) group by id)"
_REACHED = "t as (select a.turn, f.id, cast(f.id as string) as path from asked a join (select distinct id from folders) f on f.id = a.id union all select t.turn, f.id, t.path || '/' || f.id from t join folders f on f.parent = t.id where not contains('/' || t.path || '/', '/' || f.id || '/'))"


@query(derived_sql("folders", "files") + f", {_ASKED}, {_REACHED}, l as (select f.id, f.size, t.turn, t.path from t join files f on f.parent = t.id) select id, arg_min(size, (turn, path)) size, min(turn) first_asked from l group by id")
def s6_snapshot_of_folders(spark, sf_dir):
    """The files below the folders that were asked for (S2): each once, from the first that leads to it."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    return _recursive(spark, sf_dir, f"{_ASKED}, {_REACHED}, l as (select f.id, f.size, t.turn, t.path from t join {{files}} f on f.parent = t.id) select id, min_by(size, struct(turn, path)) as size, min(turn) as first_asked from l group by id")


@query(derived_sql("records", "items") + """, s as (select cast(substr(run_id, 2) as bigint) document_id, ord paragraph_id, edited is not null and edited is distinct from source_text changed from items where decision is not null)
    select coalesce(r.document_id, s.document_id) document_id, coalesce(r.paragraph_id, s.paragraph_id) paragraph_id, case when s.document_id is null then r.is_modified else coalesce(r.is_modified, false) or changed or r.synced_at is null end is_modified, r.document_id is null created
    from (select * from records where document_id % 11 <> 0) r full join s on s.document_id = r.document_id and s.paragraph_id = r.paragraph_id""")
def r5_mirrored_records(spark, sf_dir):
    """Records after a save was mirrored: modified stays so, and becomes so where the text changed or was never synchronised; missing records are made."""
    kept = derived(spark, sf_dir, "records").filter("document_id % 11 <> 0").select("document_id", "paragraph_id", "is_modified", "synced_at", F.lit(True).alias("there"))
    changed = F.col("edited").isNotNull() & ~F.col("edited").eqNullSafe(F.col("source_text"))
    saved = derived(spark, sf_dir, "items").filter("decision is not null").select(F.substring("run_id", 2, 20).cast("long").alias("document_id"), F.col("ord").alias("paragraph_id"), changed.alias("changed"))
    both = kept.join(saved, ["document_id", "paragraph_id"], "full_outer")
    touched = F.coalesce("is_modified", F.lit(False)) | F.col("changed") | F.col("synced_at").isNull()
    return both.select("document_id", "paragraph_id", F.when(F.col("changed").isNull(), F.col("is_modified")).otherwise(touched).alias("is_modified"), F.col("there").isNull().alias("created"))


@query("select p_type, p_name, count(*) n from part where p_type not in ('ECONOMY', 'SMALL') and p_partkey % 2 = 0 group by 1, 2 union all select p_type, p_name, count(*) from part where p_type in ('ECONOMY', 'SMALL') and p_partkey % 3 = 0 group by 1, 2")
def r13_replaced_children(spark, sf_dir):
    """Aliases of types after some types were saved: their children are replaced as a whole, those of others stay."""
    part = load(spark, sf_dir, "part", "p_type", "p_name", "p_partkey")
    held = part.filter("p_partkey % 2 = 0").groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("n"))
    saved = part.filter("p_type in ('ECONOMY', 'SMALL') and p_partkey % 3 = 0").groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("n"))
    types = part.filter("p_type in ('ECONOMY', 'SMALL')").select("p_type").distinct()
    return held.join(types, "p_type", "left_anti").unionByName(saved)
