"""Clause trees by a depth stack, and what is read off their intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles
from ..functions.numbers import typed_number
from ..operators import batching, clauses, outline
from ..sources.shared import cut, dealt, undealt
from ..sources.tables import load
from .derived import derived, derived_sql
from .registry import query

#: Lines with the number that each starts with: cls is null for text.
_LEX = derived_sql("lines") + r""", l0 as (select *, case
        when regexp_matches(text, '^\s*\d+(\.\d+)+\.?(\s+|["(])') then 'dotted' when regexp_matches(text, '^\s*(SECTION|Section|ARTICLE|Article|CLAUSE|Clause)\s+([0-9]|[IVXLC])') then 'section'
        when regexp_matches(text, '^\s*\d{1,3}[.)]\s+') then 'num_dot' when regexp_matches(text, '^\s*\(([A-Za-z]{1,4}|\d{1,3})\)') then 'paren' when regexp_matches(text, '^\s*[A-Za-z][.)]\s') then 'alpha_dot' end kind from lines),
    l1 as (select *, case kind when 'dotted' then regexp_extract(text, '(\d+(\.\d+)+)', 1) when 'section' then regexp_extract(text, '^\s*\w+\s+([0-9]+)', 1) when 'paren' then regexp_extract(text, '\((\w+)\)', 1) else regexp_extract(text, '^\s*(\w+)', 1) end token from l0),
    l2 as (select *, case when kind in ('dotted', 'section') then kind when regexp_matches(token, '^\d+$') then 'decimal' when lower(token) in ('i', 'v', 'x') then 'ambiguous' when regexp_matches(lower(token), '^x{0,3}(ix|iv|v?i{0,3})$') then 'roman' else 'alpha' end cls,
        regexp_extract(text, '^\s*(\S+( \d+:)?)', 1) shown, case when kind = 'paren' then 'paren' when substr(trim(text), length(token) + 1, 1) = ')' then 'rparen' else 'dot' end delim, token <> lower(token) and token = upper(token) up
        from l1 where kind is not null and heading is null and not regexp_matches(text, '^\S+ (of|and|or)[ ,;]')),
    lex as (select lines.*, cls, token, shown, delim, up from lines left join l2 using (doc, ord))"""

_DEPTHS = _LEX + """, p as (
        select distinct doc, 0::bigint n, []::struct(s varchar, l varchar)[] st, 0 base, null::integer depth, null::integer heading, null::varchar shown from lines
        union all
        select doc, ord, case when heading is not null then [] when c is null then st when c = 'section' then [x] when c = 'dotted' then list_concat(list_resize(st, dots, {'s': 'skipped', 'l': ''}), [x]) when again then list_concat(st[1:was - 1], [x]) when starts then list_concat(st, [x]) else st end,
            case when heading is not null then heading + 1 else base end,
            case when heading is not null then heading when c is null then null when c = 'section' then base when c = 'dotted' then base + dots when again then base + was - 1 when starts then base + len(st) end, heading, shown
        from (select *, was is not null and not (starts and coalesce(band > was - 1, false)) again from (
            select *, {'s': style, 'l': token} x, list_position(list_transform(st, lambda e: e.s), style) was, lower(token) in ('1', 'a', 'i') starts, length(token) - length(replace(token, '.', '')) dots from (
                select *, concat_ws('/', c, up, delim) style from (
                    select l.*, p.st, p.base, case when cls <> 'ambiguous' then cls when list_contains(list_transform(list_filter(st, lambda e: e.s = concat_ws('/', 'alpha', up, delim)), lambda e: lower(e.l)), chr(ascii(lower(token)) - 1)) then 'alpha' else 'roman' end c
                    from p join lex l on l.doc = p.doc and l.ord = p.n + 1))))
    )"""

_TREE = _DEPTHS + r""", d as (select doc, n ord, depth, heading is not null heading, case when heading is null then shown end number, row_number() over (partition by doc order by n) k from p where depth is not null),
    t as (
        select distinct doc, 0::bigint k, 0 cnt, []::struct(num varchar, depth integer, heading boolean, start integer)[] st, null::bigint ord, null::integer depth, null::varchar number, null::boolean heading, null::varchar ph, null::integer ph_depth, null::integer ph_parent, 0 ph_level, null::integer parent, 0 as level from d
        union all
        select doc, k, cnt + 1 + (ph is not null)::integer, list_append(s4, {'num': own, 'depth': depth, 'heading': heading, 'start': cnt + 1 + (ph is not null)::integer}), ord, depth, number, heading, ph, above, s1[-1].start, len(s1) + 1, s4[-1].start, len(s4) + 1
        from (select *, case when found is not null then s3 else s3[1:coalesce(list_max(list_filter(range(1, len(s3) + 1), lambda i: s3[i].depth < depth)), 0)] end s4
        from (select *, case when heading and found is null then s2[1:coalesce(list_max(list_filter(range(1, len(s2) + 1), lambda i: s2[i].heading)), 0)] else s2 end s3
        from (select *, case when found is not null then st[1:found] when ph is not null then list_append(s1, {'num': ph, 'depth': above, 'heading': false, 'start': cnt + 1}) else s1 end s2
        from (select *, case when named is not null and found is null and (nearest is null or starts_with(named, nearest || '.')) then named end ph
        from (select *, list_filter(list_transform(s1, lambda e: e.num), lambda x: x is not null)[-1] nearest
        from (select *, case when named is not null and found is null then st[1:coalesce(list_max(list_filter(range(1, len(st) + 1), lambda i: st[i].depth < above)), 0)] else st end s1
        from (select *, list_max(list_filter(range(1, len(st) + 1), lambda i: st[i].num = named)) found, greatest(depth - 1, 0) above
        from (select *, case when contains(own, '.') then regexp_replace(own, '\.\d+$', '') end named
        from (select d.*, t.st, t.cnt, case when regexp_matches(trim(d.number, '.'), '^\d+(\.\d+)*$') then regexp_replace(trim(d.number, '.'), '(\.0)+$', '') end own from t join d on d.doc = t.doc and d.k = t.k + 1)))))))))
    ),
    nodes as (
        select doc, ord, 'node' kind, number, depth, cnt as start, parent, level, heading from t where k > 0
        union all select doc, null, 'placeholder', ph, ph_depth, cnt - 1, ph_parent, ph_level, false from t where ph is not null),
    tree as (
        select doc, ord, kind, number, depth, start, coalesce((select min(b.start) - 1 from nodes b where b.doc = a.doc and b.start > a.start and b.level <= a.level), (select max(b.start) from nodes b where b.doc = a.doc)) stop, parent, level,
            (select count(*) from nodes b where b.doc = a.doc and b.parent = a.start) children, heading from nodes a)"""


@query(_LEX + " select doc, ord, cls, token, delim, up as upper from lex")
def p13_typed_numbers_of_lines(spark, sf_dir):
    """The number that each line starts with, in one of seven classes; none for text and for references that were wrapped."""
    rows = derived(spark, sf_dir, "lines").withColumn("n", F.when(F.col("heading").isNull(), typed_number(F.col("text"))))
    return rows.select("doc", "ord", "n.cls", "n.token", "n.delim", "n.upper")


@query(_TREE + " select doc, ord, kind, number, depth, start, stop, parent, level, children, heading from tree union all select doc, n, 'body', null, null, null, null, (select max(start) from tree c where c.doc = p.doc and c.ord < p.n), null, null, null from p where n > 0 and depth is null")
def p25_outline(spark, sf_dir):
    """The clause tree of each document: nodes with intervals, placeholder parents, and bodies."""
    return outline.outline(derived(spark, sf_dir, "lines")).drop("path")


def _words(*sets) -> str:
    return "[" + ", ".join(f"'{w}'" for ws in sets for w in ws) + "]"


_HAS_UPPER = "(regexp_matches({0}, '^\\P{{Ll}}*$') and regexp_matches({0}, '\\p{{Lu}}'))"


def _title_sql(text: str) -> str:
    """colon_title in SQL, of an expression."""
    t = f"trim(regexp_extract(ltrim({text}), '^([^:]+):', 1))"
    ws = f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
    low = f"list_transform({ws}, lambda w: lower(trim(w, '.,()[]')))"
    voting = f"list_filter({ws}, lambda w: regexp_matches(w, '^\\p{{L}}') and not list_contains({_words(titles.MINOR)}, lower(trim(w, '.,()[]'))))"
    cased = f"(len({voting}) > 0 and len(list_filter({voting}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= {titles.CAPITAL_SHARE} * len({voting}))"
    caps = f"len(list_filter({ws}, lambda w: regexp_matches(w, '^\\p{{L}}'))) > 0"
    return f"case when length({t}) between 1 and {titles.TITLE_CHARS} and len({ws}) <= {titles.TITLE_WORDS} and not coalesce(list_contains({_words(titles.LEADERS)}, {low}[1]), false) and not list_has_any({low}, {_words(titles.VERBS)}) and case when {_HAS_UPPER.format(t)} then {caps} else {cased} end then {t} end"


def _heading_sql(text: str) -> str:
    t = f"regexp_replace(coalesce({text}, ''), '^\\s+|\\s+$', '', 'g')"
    ws = f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
    long = f"list_filter({ws}, lambda w: length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) >= 4)"
    titled = f"(len({long}) > 0 and len(list_filter({long}, lambda w: not regexp_matches(ltrim(w, '(' || chr(34) || chr(39)), '^\\p{{Lu}}'))) = 0)"
    return f"(len({ws}) = 0 or (len({ws}) <= {titles.HEADING_WORDS} and ({_HAS_UPPER.format(t)} or (not ends_with({t}, ':') and {titled}))))"


def _form_sql(text: str) -> str:
    bare = f"regexp_replace({text}, '_{{4,}}|\\.{{6,}}|[\\[\\]]', ' ', 'g')"
    ws = f"list_filter(list_transform(string_split_regex({bare}, '\\s+'), lambda w: regexp_replace(lower(trim(w, '.,:;()[]''\"’')), '[''’]s$', '')), lambda w: w <> '')"
    n = lambda words: f"len(list_filter({ws}, lambda w: list_contains({words}, w)))"
    fields = f"len(list_distinct(list_filter({ws}, lambda w: list_contains({_words(titles.FIELDS)}, w))))"
    return f"""coalesce(len(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')) <= {titles.FORM_WORDS} and regexp_matches({text}, '_{{4,}}|\\.{{6,}}|\\[\\[?[^\\]]{{1,80}}\\]\\]?')
        and {n(_words(titles.VERBS))} = 0 and ({n(_words(titles.SIGNING))} > 0 or {fields} >= 2) and len({ws}) - {n(_words(titles.SIGNING, titles.FIELDS))} <= {titles.FORM_OTHERS}, false)"""


_CLAUSES = _TREE + f""", bodies as (select doc, parent as start, list(text order by ord) b, list(ord order by ord) o from (select p.doc, p.n ord, l.text, (select max(start) from tree c where c.doc = p.doc and c.ord < p.n) parent from p join lines l on l.doc = p.doc and l.ord = p.n where p.depth is null) where parent is not null group by all),
    said as (select t.*, coalesce(case when t.heading then l.text else trim(substr(l.text, length(t.number) + 1)) end, '') as text, coalesce(b.b, []) b, list_concat(case when t.kind = 'node' then [t.ord] else [] end, coalesce(b.o, [])) paragraphs
        from tree t left join lines l using (doc, ord) left join bodies b on b.doc = t.doc and b.start = t.start),
    cl as (select *, {_title_sql('text')} title, array_to_string(b, chr(10)) body, array_to_string(list_filter(list_concat([text], b), lambda x: x <> ''), chr(10)) own,
        case when kind = 'placeholder' then 'inferred_parent' when heading then 'outline_level' else 'typed_numbering' end source, case when kind = 'placeholder' then 0.5::double when heading then 0.95::double else 0.75::double end confidence from said)"""

_EXH, _EXE = "|".join(p.replace(" ", "\\s+") for p in titles.EXHIBITS), "|".join(p.replace(" ", "\\s+") for p in titles.EXECUTION)
_PLACED = _CLAUSES + f""", mark as (select *, string_split_regex(trim(text), '\\s+')[1:8] f,
        (regexp_matches(coalesce(title, ''), '(?i)\\b(?:{_EXH})\\b') or regexp_matches(trim(text), '(?i)^\\b(?:{_EXH})\\b') or (len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 12 and regexp_matches(text, '(?i)\\b(?:{_EXH})\\b'))) exhibit from cl),
    mark2 as (select *, list_position(list_transform(f, lambda w: {_HAS_UPPER.format('w')}), false) q from mark),
    mark3 as (select *, case when q is null or q = 0 then array_to_string(f, ' ') else array_to_string(f[1:q - 1], ' ') end caps, coalesce(nullif(trim(string_split(trim(text), '.')[1]), ''), trim(text)) head from mark2),
    mark4 as (select *, trim(rtrim(coalesce(number, ''), '.') || ' ' || coalesce(title, case when length(caps) >= 3 then rtrim(caps, '.,:;') else rtrim(left(head, 48)) || case when length(head) > 48 then '...' else '' end end)) step from mark3),
    pl as (select c.doc, c.start, array_to_string(list(a.step order by a.level) filter (a.step <> ''), ' > ') breadcrumb, case when bool_or(a.exhibit) then 'exhibit' when regexp_matches(string_agg(coalesce(a.title, '') || ' ' || left(a.text, 160), ' ' order by a.level), '(?i)\\b(?:{_EXE})\\b') then 'execution' else 'body' end region
        from mark4 c join mark4 a on a.doc = c.doc and a.start <= c.start and c.start <= a.stop group by 1, 2),
    placed as (select cl.*, coalesce(pl.breadcrumb, '') breadcrumb, pl.region, q.own lead_in from cl join pl using (doc, start) left join cl q on q.doc = cl.doc and q.start = cl.parent)"""

_CHUNKS = _PLACED + f""", macro as (select a.doc, a.start, 0 turn, 'macro' kind, coalesce(string_agg(nullif(p.own, ''), chr(10) order by p.start), '') as text, list(p.start order by p.start) cls, coalesce(list_sort(list_distinct(flatten(list(p.paragraphs)))), []) paras, case when count(distinct p.region) > 1 then 'mixed' else a.region end region, true indexed
        from placed a join placed p on p.doc = a.doc and p.start between a.start and a.stop where a.children > 0 group by a.doc, a.start, a.region),
    made as (select *, row_number() over (partition by doc order by start, turn) place, length(text) chars from (select * from macro union all select doc, start, 1, 'micro', own, [start], paragraphs, region, children = 0 and parent is null from placed where children = 0 or trim(body) <> '' or not {_heading_sql('text')}))"""


def _clauses(spark, sf_dir):
    lines = derived(spark, sf_dir, "lines")
    return clauses.clauses(cut(outline.outline(lines)), lines)


def _placed(spark, sf_dir, needed):
    """needed(placed clauses), kept by document; what it is made from is kept so too, and goes when it is there."""
    lines = dealt(derived(spark, sf_dir, "lines"), "doc")
    tree = dealt(outline.outline(lines), "doc")
    said = dealt(clauses.clauses(tree, lines), "doc")
    undealt(tree, lines)
    out = dealt(needed(clauses.placed(said)), "doc")
    undealt(said)
    return out


@query(_CLAUSES + " select doc, start, parent, coalesce(title, '-') title, own, array_to_string(paragraphs, ',') paragraphs, source, confidence from cl")
def p28_clause_rows(spark, sf_dir):
    """The clauses of each document with their own words and paragraphs."""
    return _clauses(spark, sf_dir).select("doc", "start", "parent", F.coalesce("title", F.lit("-")).alias("title"), "own", F.array_join("paragraphs", ",").alias("paragraphs"), "source", "confidence")


@query(_PLACED + " select doc, start, breadcrumb, region, lead_in from placed")
def c8_regions(spark, sf_dir):
    """Breadcrumb, region and lead-in of each clause, from the chain above it."""
    return clauses.placed(_clauses(spark, sf_dir)).select("doc", "start", "breadcrumb", "region", "lead_in")


@query(_CHUNKS + " select doc, start, place, kind, text, array_to_string(cls, ',') clauses, array_to_string(paras, ',') paragraphs, region, indexed from made")
def c11_tree_chunks(spark, sf_dir):
    """Macro and micro chunks of the clause trees, in order of emission, with regions."""
    rows = cut(clauses.placed(_clauses(spark, sf_dir)))
    return clauses.chunks(rows).select("doc", "start", "place", "kind", "text", F.array_join("clauses", ",").alias("clauses"), F.array_join("paragraphs", ",").alias("paragraphs"), "region", "indexed")


@query(_CHUNKS + """ select m.doc, count(*) chunks, count(*) filter (kind = 'macro') macros, count(*) filter (kind = 'micro') micros, count(*) filter (indexed) indexed, count(*) filter (region = 'body') body_chunks, count(*) filter (region = 'execution') execution_chunks, count(*) filter (region = 'exhibit') exhibit_chunks, count(*) filter (region = 'mixed') mixed_chunks,
    max(chars) largest, (select place from made b where b.doc = m.doc order by chars desc, place limit 1) largest_place, list_sort(list(chars))[count(*) // 2 + 1] median, (select count(*) from cl where cl.doc = m.doc and not list_contains(flatten(list(m.cls)), cl.start)) clauses_missing,
    (select count(*) from cl where cl.doc = m.doc and not list_contains(flatten(coalesce(list(m.cls) filter (m.indexed), [])), cl.start)) clauses_unreachable, 0::bigint paragraphs_missing from made m group by m.doc""")
def c12_coverage_gates(spark, sf_dir):
    """What proves that each document's chunks lose no clause and no paragraph, and their sizes."""
    rows = _placed(spark, sf_dir, clauses.sized)
    made = dealt(clauses.chunks(rows).drop("start", "regions"), "doc")
    found = dealt(clauses.gates(rows, made), "doc")
    undealt(rows, made)
    return found


@query(_TREE + """, up as (select b.doc, b.start, list(a.start order by a.level) chain from tree a join tree b on b.doc = a.doc and a.start <= b.start and b.start <= a.stop group by 1, 2)
    select t.doc, t.start, level, array_to_string(chain, '/') path, children child_count, (select count(*) from tree b where b.doc = t.doc and b.start > t.start and b.start <= t.stop) descendant_count, cast(row_number() over (partition by t.doc, parent order by t.start) as integer) sibling_index,
    count(*) over (partition by t.doc, parent) sibling_count, t.start dfs, cast(row_number() over (partition by t.doc order by level, t.start) as integer) bfs from tree t join up using (doc, start)""")
def p27_relations(spark, sf_dir):
    """Levels, paths, counts and orders of each clause of the trees."""
    return clauses.related(cut(outline.outline(derived(spark, sf_dir, "lines"))))


@query(_TREE + ", up as (select doc, start, parent anc, 1 as distance from tree where parent is not null union all select u.doc, u.start, t.parent, distance + 1 from up u join tree t on t.doc = u.doc and t.start = u.anc where t.parent is not null) select doc, start, anc ancestor, distance from up")
def j19_ancestor_chains(spark, sf_dir):
    """Every ancestor of each clause, from the paths."""
    return outline.below(cut(outline.outline(derived(spark, sf_dir, "lines")))).select("doc", F.col("inner").alias("start"), F.col("start").alias("ancestor"), "distance")


@query(_TREE + " select doc, parent as start, string_agg(start::varchar, ',' order by start) children from tree where parent is not null group by 1, 2")
def c1_children_in_order(spark, sf_dir):
    """The children of each clause, in reading order."""
    rows = outline.outline(derived(spark, sf_dir, "lines")).filter("kind <> 'body' and parent is not null")
    return rows.groupBy("doc", F.col("parent").alias("start")).agg(F.array_join(F.sort_array(F.collect_list(rows["start"])), ",").alias("children"))


@query(_CLAUSES + " select c.doc, c.start lead, string_agg(k.start::varchar, ',' order by k.start) bonded from cl c join tree k on k.doc = c.doc and k.parent = c.start where rtrim(case when len(c.b) > 0 then c.b[-1] else c.text end) like '%:' group by 1, 2")
def p26_lead_ins(spark, sf_dir):
    """Clauses whose last words end with a colon, and the children bonded to them."""
    rows = cut(_clauses(spark, sf_dir))
    leads = rows.filter(F.rtrim("own").endswith(":") & (F.col("children") > 0)).select("doc", F.col("start").alias("parent"))
    return rows.select("doc", "parent", "start").join(leads, ["doc", "parent"]).groupBy("doc", F.col("parent").alias("lead")).agg(F.array_join(F.sort_array(F.collect_list("start")), ",").alias("bonded"))


@query(_CLAUSES + """, s as (select c.*, q.depth pd, try_cast(regexp_extract(c.number, '([0-9]+)[^0-9]*$', 1) as bigint) tail from cl c left join tree q on q.doc = c.doc and q.start = c.parent), g as (select *, last_value(tail ignore nulls) over (partition by doc, parent order by start rows between unbounded preceding and 1 preceding) before from s)
    select doc, start, concat_ws(',', case when confidence < 0.75 and source = 'typed_numbering' then 'low_confidence' end, case when kind = 'placeholder' then 'inferred_parent' when trim(own) = '' then 'empty_text' end, case when depth > coalesce(pd, -1) + 1 then 'depth_jump' end, case when tail > before + 1 then 'sequence_gap' end) flags from g""")
def p29_clause_flags(spark, sf_dir):
    """What each clause should be looked at for."""
    return clauses.flags(_clauses(spark, sf_dir))


@query(_CLAUSES + " select doc, level, source, count(*) n from cl group by all")
def a23_clauses_by_level(spark, sf_dir):
    """Clauses by level and source of numbering."""
    return _clauses(spark, sf_dir).groupBy("doc", "level", "source").agg(F.count("*").alias("n"))


@query(_TREE + " select c.doc, c.start, q.ord parent_ord, c.parent is not null and q.ord is null placed_under_placeholder from tree c left join tree q on q.doc = c.doc and q.start = c.parent")
def j5_parent_rows(spark, sf_dir):
    """Each clause with the line of its parent; roots, and children of placeholders, have none."""
    rows = cut(outline.outline(derived(spark, sf_dir, "lines"))).filter("kind <> 'body'")
    above = rows.select("doc", F.col("start").alias("parent"), F.col("ord").alias("parent_ord"))
    return rows.select("doc", "start", "parent").join(above, ["doc", "parent"], "left").select("doc", "start", "parent_ord", (F.col("parent").isNotNull() & F.col("parent_ord").isNull()).alias("placed_under_placeholder"))


@query(f"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) n, unnest(string_split(text, chr(10))) line from documents where text is not null)
    select doc_id, n, {_title_sql('line')} title, {_heading_sql('line')} heading, {_form_sql('line')} form from l
    union all select doc, ord, {_title_sql('text')}, {_heading_sql('text')}, {_form_sql('text')} from ({derived_sql('lines')} select * from lines)""")
def p20_line_words(spark, sf_dir):
    """Of each line of the documents and of the derived ones: a title with a colon, whether it is a mere heading, and whether it is a line to sign."""
    split = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("n"), "line")
    rows = split.union(derived(spark, sf_dir, "lines").select("doc", "ord", "text"))
    line = F.col("line")
    return rows.select("doc_id", "n", titles.colon_title(line).alias("title"), titles.heading_only(line).alias("heading"), titles.form_line(line).alias("form"))


#: Limits of a batch in the query below.
_TOKENS, _ITEMS = 400, 6
_TOK = "greatest(1, length(coalesce({0}, '')) // 4)"


@query(_CHUNKS + f""", it as (select m.doc, coalesce(p.parent::varchar, 'root:' || p.start) section, m.place as t, {_TOK.format('m.text')} + {_TOK.format('p.lead_in')} + {_TOK.format('p.breadcrumb')} + {_TOK.format('p.title')} + 12 cost,
        {_TOK.format('q.breadcrumb')} + {_TOK.format("array_to_string(list_filter(string_split_regex(coalesce(q.own, ''), '\\s+'), lambda w: w <> '')[1:15], ' ')")} + 8 overhead
        from made m join placed p using (doc, start) left join placed q on q.doc = p.doc and q.start = p.parent where m.kind = 'micro'),
    se as (select doc, section, count(*) n, sum(cost) + max(overhead) total, min(t) first_t from it group by 1, 2),
    o as (select it.*, n, total, row_number() over (partition by doc order by first_t, t) k from it join se using (doc, section)),
    f as (select doc, 0::bigint k, -1::bigint piece, null::varchar section, 0::bigint cnt, 0::bigint used from (select distinct doc from o)
        union all select doc, k, piece + new::bigint, section, case when new then 1 else cnt + 1 end, case when new then overhead + cost else used + cost end
        from (select o.doc, o.k, f.piece, o.section, f.cnt, f.used, o.cost, o.overhead, f.section is distinct from o.section or ((n > {_ITEMS} or total > {_TOKENS}) and (f.cnt >= {_ITEMS} or f.used + o.cost > {_TOKENS})) new from f join o on o.doc = f.doc and o.k = f.k + 1)),
    pc as (select o.doc, f.piece, count(*) size, sum(cost) + max(overhead) al from o join f using (doc, k) group by 1, 2),
    b as (select doc, -1::bigint piece, -1::bigint batch, 0::bigint cnt, 0::bigint used from (select distinct doc from o)
        union all select doc, piece, batch + new::bigint, case when new then size else cnt + size end, case when new then al else used + al end
        from (select pc.doc, pc.piece, b.batch, b.cnt, b.used, pc.size, pc.al, b.batch < 0 or b.cnt + pc.size > {_ITEMS} or b.used + pc.al > {_TOKENS} new from b join pc on pc.doc = b.doc and pc.piece = b.piece + 1))
    select o.doc, o.section, o.t place, cost, overhead, f.piece, b.batch, 'p' || row_number() over (partition by o.doc, b.batch order by f.piece, o.t) as local, row_number() over (partition by o.doc, b.batch order by f.piece, o.t) > count(*) over (partition by o.doc, b.batch) // 2 second_half
    from o join f using (doc, k) join b on b.doc = o.doc and b.piece = f.piece""")
def m5_section_batches(spark, sf_dir):
    """The micro chunks of each document by the section of their parent, planned into requests."""
    cost = batching.paragraph_cost(F.col("own"), F.col("lead_in"), F.col("breadcrumb"), F.col("title"))
    own = batching.section_cost(F.col("breadcrumb"), batching.preview(F.col("own")))
    placed = _placed(spark, sf_dir, lambda rows: clauses.sized(rows.withColumns({"cost": cost, "overhead": own}), "cost", "overhead"))
    parents = placed.filter("children > 0").select("doc", F.col("start").alias("parent"), "overhead")
    micros = clauses.chunks(placed).filter(F.col("kind") == clauses.MICRO).select("doc", "start", F.col("place").alias("at"))
    rows = micros.join(placed.select("doc", "start", "parent", "cost"), ["doc", "start"]).join(parents, ["doc", "parent"], "left")
    section = F.coalesce(F.col("parent").cast("string"), F.concat(F.lit("root:"), "start"))
    items = dealt(rows.select("doc", section.alias("section"), "at", "cost", F.coalesce("overhead", batching.section_cost(F.lit(None), F.lit(None))).alias("overhead")), "doc")
    undealt(placed)
    out = batching.plan(items, _TOKENS, _ITEMS).withColumnRenamed("at", "place")
    undealt(items)
    return out
