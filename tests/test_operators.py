"""Operators against brute force, and at the edges of their rules."""

import itertools
import json
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchment.functions import folding, inline, numbers, titles
from parchment.operators import batching, clauses, diffs, outline, phrases
from parchment.operators.fallback import kept
from parchment.operators.keyed_table import KeyedTable
from parchment.operators.running import running
from parchment.sources import shared
from parchment.sources.shared import new_path

LINES = "doc long, ord long, text string, heading int, band int"


# Numbers


def test_number_formats_have_no_limit(spark):
    def letters(n):
        out = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out

    some = [-3, 0, 1, 26, 27, 52, 53, 100, 444, 702, 703, 18278, 18279, 475255, 10**9, 10**12]
    rows = spark.createDataFrame([(n,) for n in some], "n long").select("n", numbers.letters(F.col("n")).alias("l"), numbers.formatted(F.col("n"), F.lit("decimalZero")).alias("z")).collect()
    assert {r.n: r.l for r in rows} == {n: letters(n) for n in some}
    assert {r.n: r.z for r in rows if r.n >= 0} == {n: f"{n:02d}" for n in some if n >= 0}
    roman = dict(spark.createDataFrame([(n,) for n in (0, 4, 444, 1994, 3999, 4000, 6001)], "n long").select("n", numbers.roman(F.col("n"))).collect())
    assert roman == {0: "", 4: "iv", 444: "cdxliv", 1994: "mcmxciv", 3999: "mmmcmxcix", 4000: "mmmm", 6001: "mmmmmmi"}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1.2.3. Deep", ("dotted", "1.2.3", "dot", "Deep")), ("22.4 and 22.5 apply", None), ("Section 4(a): Fees", ("section", "4(a)", "dot", "Fees")), ("7) seven", ("decimal", "7", "rparen", "seven")),
        ("12. of, them", None), ("(a) letter", ("alpha", "a", "paren", "letter")), ("(i) which", ("ambiguous", "i", "paren", "which")), ("II. Roman", ("roman", "II", "dot", "Roman")), ("IIV. none", None),
        ("B. Letter", ("alpha", "B", "dot", "Letter")), ('1.1"quoted"', ("dotted", "1.1", "dot", '"quoted"')), ("2020 year", None), ("", None), (None, None),
    ],
)
def test_typed_numbers(spark, line, want):
    found = spark.createDataFrame([(line,)], "t string").select(numbers.typed_number(F.col("t")).alias("n")).first().n
    assert (found and (found.cls, found.token, found.delim, found.rest)) == want


# Outlines


def tree_of(spark, lines):
    rows = [(1, n, *(line if isinstance(line, tuple) else (line, None)), None) for n, line in enumerate(lines)]
    return sorted(outline.outline(spark.createDataFrame(rows, LINES)).collect(), key=lambda r: (r.start is None, r.start))


def test_a_tree_of_forty_levels(spark):
    lines = [".".join(["1"] * n) + " x" if n > 1 else "1. x" for n in range(1, 41)]
    got = tree_of(spark, lines)
    assert [r.level for r in got] == list(range(1, 41)) and [r.parent for r in got] == [None, *range(1, 40)]
    pairs = outline.below(outline.outline(spark.createDataFrame([(1, n, t, None, None) for n, t in enumerate(lines)], LINES))).collect()
    assert len(pairs) == 40 * 39 // 2 and all(r.distance == r.inner - r.start for r in pairs)


def test_placeholders_and_contradictions(spark):
    got = tree_of(spark, [("Terms", 0), "2.1 first", "2.1.1 under it", "2.2 next", "4.1.1 far", "text"])
    assert [(r.kind, r.number, r.parent) for r in got if r.kind != "body"] == [
        ("node", None, None), ("placeholder", "2", 1), ("node", "2.1", 2), ("node", "2.1.1", 3), ("node", "2.2", 2), ("node", "4.1.1", 2),
    ]
    # A 4.1 below the open 2 would contradict it: no parent is invented, and 4.1.1 stands where its depth puts it.
    assert got[-1].kind == "body" and got[-1].parent == 6
    got = tree_of(spark, [("Terms", 0), "1. one", "2. two", "(a) letter", "3.1 other"])
    assert [(r.kind, r.number) for r in got] == [("node", None), ("node", "1."), ("node", "2."), ("node", "(a)"), ("placeholder", "3"), ("node", "3.1")]


def test_typed_levels_continue_lists_and_open_only_with_a_first():
    t = outline.TypedLevels()
    number = lambda token, cls="alpha", delim="paren", **k: t.depth(token, cls, token.isupper(), delim, **k)
    assert [number(x) for x in "abcdefgh"] == [0] * 8
    assert number("i", "ambiguous") == 0 and number("i", "ambiguous") == 1 and number("ii", "roman") == 1
    assert number("x", "alpha", "dot") is None and number("B") is None and number("A") == 2
    assert number("c") == 0 and number("A") == 1
    assert number("a", band=2) == 2  # the same style again, but deeper
    assert t.depth("3.1.4", "dotted", False, "dot") == 2 and len(t.styles) == 3
    assert t.depth("4", "section", False, "dot", with_sections=False) is None and t.depth("4", "section", False, "dot") == 0 and len(t.styles) == 1


def test_outline_of_many_documents_equals_one_by_one(spark):
    rng = random.Random(3)
    words = ["1. a", "2. b", "1.1 c", "1.2.1 d", "(a) e", "(i) f", "(b) g", "A. h", "text", None, "Section 2: k"]
    rows = [(d, n, rng.choice(words), rng.choice([None, None, None, 0, 1]), rng.choice([None, 0, 2])) for d in range(60) for n in range(rng.randrange(1, 40))]
    everything = outline.outline(spark.createDataFrame([*rows, (None, 1, "1. x", None, None)], LINES)).collect()
    assert {r.doc for r in everything} == set(range(60)) and sum(r.ord is not None for r in everything) == len(rows)
    for d in range(0, 60, 20):
        alone = outline.outline(spark.createDataFrame([r for r in rows if r[0] == d], LINES)).collect()
        assert sorted(map(repr, alone)) == sorted(repr(r) for r in everything if r.doc == d)
    for d in range(60):  # intervals nest, and count what is below
        nodes = [r for r in everything if r.doc == d and r.start is not None]
        by = {r.start: r for r in nodes}
        assert sorted(by) == list(range(1, len(nodes) + 1))
        for r in nodes:
            assert r.start <= r.stop and r.children == sum(x.parent == r.start for x in nodes)
            if r.parent:
                assert by[r.parent].start < r.start and r.stop <= by[r.parent].stop and by[r.parent].level == r.level - 1


def test_gates_see_what_is_lost(spark):
    lines = spark.createDataFrame([(1, n, t, None, None) for n, t in enumerate(["1. ONE", "1.1 sub", "more words", "Section 2: Two"])], LINES)
    rows = clauses.placed(clauses.clauses(outline.outline(lines), lines))
    made = clauses.chunks(rows)
    whole = clauses.gates(rows, made).first()
    assert (whole.clauses_missing, whole.clauses_unreachable, whole.paragraphs_missing, whole.chunks, whole.macros, whole.indexed) == (0, 0, 0, 3, 1, 2)
    part = clauses.gates(rows, made.filter("kind = 'micro'")).first()
    assert (part.clauses_missing, part.clauses_unreachable, part.paragraphs_missing) == (1, 2, 1)


def _exchanges(df) -> int:
    with shared.writing(df.sparkSession):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_trees_and_gates_of_tables_dealt_by_document_exchange_nothing(spark):
    texts = ["1. ONE", "1.1 sub", "more words", "Section 2: Two", "(a) three", ""]
    plain = spark.createDataFrame([(d, n, t, None, None) for d in range(40) for n, t in enumerate(texts)], LINES)
    want = clauses.placed(clauses.clauses(outline.outline(plain), plain))
    lines = shared.dealt(plain, "doc")
    tree = shared.dealt(outline.outline(lines), "doc")
    rows = shared.dealt(clauses.sized(clauses.placed(clauses.clauses(tree, lines))), "doc")
    made = shared.dealt(clauses.chunks(rows), "doc")
    steps = [outline.outline(lines), clauses.placed(clauses.clauses(tree, lines)), clauses.chunks(rows), clauses.gates(rows, made)]
    assert [_exchanges(x) for x in steps] == [0] * 4
    # Sizes without texts are those of the texts.
    columns = ["doc", "start", "place", "kind", "chars", "clauses", "paragraphs", "region", "indexed"]
    assert sorted(map(repr, made.select(columns).collect())) == sorted(map(repr, clauses.chunks(want).withColumn("chars", F.length("text")).select(columns).collect()))
    assert sorted(map(repr, clauses.gates(rows, made).collect())) == sorted(map(repr, clauses.gates(want, clauses.chunks(want)).collect()))
    shared.undealt(lines, tree, rows, made)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


# Words of lines


@pytest.mark.parametrize(
    ("text", "title", "heading", "form"),
    [
        ("Security: we comply", "Security", False, False), ("The service excludes the following: tax", None, False, False), ("TERM OF CONTRACT: two years", "TERM OF CONTRACT", False, False), ("RECITALS", None, True, False),
        ("Definitions and Interpretation", None, True, False), ("for the provision of Services", None, False, False), ("", None, True, False), ("Employee Signature ________ Date: ______", "Employee Signature ________ Date", True, True),
        ("The Effective Date is __________.", None, True, False), ("[[ Signature: Client (c60079d8) ]]", "[[ Signature", True, True), ("Beneficiary Name: [ ]", "Beneficiary Name", True, False), ("Print Name ______", None, True, True),
    ],
)
def test_words_of_a_line(spark, text, title, heading, form):
    c = F.col("t")
    r = spark.createDataFrame([(text,)], "t string").select(titles.colon_title(c).alias("title"), titles.heading_only(c).alias("heading"), titles.form_line(c).alias("form")).first()
    assert (r.heading, r.form) == (heading, form)
    if "____" not in text:
        assert r.title == title


def test_inline_clauses():
    text = "The fees are due at once and in full. 2.1 Payment Terms. They are thirty days. See also 2.2 below; Section 3 Delivery: the goods go out at once."
    assert inline.pieces(text) == ["The fees are due at once and in full.", "2.1 Payment Terms. They are thirty days. See also 2.2 below;", "Section 3 Delivery: the goods go out at once."]
    assert inline.pieces("Short. 2.1 Payment Terms. And so on, for a long while.") == ["Short. 2.1 Payment Terms. And so on, for a long while."]
    assert inline.pieces("As it is set out in the parts above. 2.1 Payment Terms. And so on, for long.")[1:] != [] and inline.boundaries("As it is set out in the parts above. 2.1 Payment Terms. And so on, for long.", references=True) == []
    assert inline.pieces('A party keeps its word to the other. 1.10."Business Day" means a day.')[1] == '1.10."Business Day" means a day.'
    assert inline.pieces(None) == [""] and inline.pieces("") == [""]


# Folding and phrases


def test_folding_equals_unicodedata_on_every_assigned_code_point():
    some = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c) != "Cn"]
    fold = str.maketrans(folding.FOLDED)
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", f"A{c} b{c}").translate(fold).casefold()).strip() for c in some]
    assert folding.fold_array(pa.array([f"A{c} b{c}" for c in some])).to_pylist() == want
    assert folding.fold_array(pa.array(["A  b", None, ""])).to_pylist() == ["a b", "", ""]


def by_regex(texts, known):
    """One alternation, longest first, between word boundaries."""
    pattern = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(map(re.escape, sorted(known, key=lambda k: (-len(k), k)))))
    return sorted((d, m.start(), m.end(), known[m[0]]) for d, t in texts for m in pattern.finditer(folding.fold_array(pa.array([t], pa.string())).to_pylist()[0]))


@pytest.mark.parametrize("part", [200_000, 7])
def test_phrase_scan_equals_one_regular_expression(spark, part):
    rng = random.Random(5)
    vocabulary = ["a", "b", "ab", "é", "x-y", "(c)", "_d", "?", "Straße"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "-", "", ".", "\n"]) for _ in range(n))
    known = {}
    for key in range(60):
        phrase = folding.fold_array(pa.array([text(rng.randrange(1, 5))])).to_pylist()[0]
        if phrase:
            known.setdefault(phrase, key)
    docs = [(d, text(rng.randrange(0, 60))) for d in range(80)] + [(100, None), (101, "")]
    rows = [*((p.upper() if "ß" not in p and "ss" not in p else p, k) for p, k in known.items()), ("", 5), (None, 6), ("  ", 7)]
    got = phrases.scan(spark.createDataFrame(docs, "doc long, text string").repartition(3), spark.createDataFrame(rows, "phrase string, key int"), part_phrases=part)
    assert sorted(map(tuple, got.collect())) == by_regex(docs, known)


def test_phrase_scan_reads_documents_once_however_many_phrases(spark, tmp_path):
    text = "zero one, two three four five six seven"
    spark.createDataFrame([(1, text), (2, "𝒳-ray é"), (3, None)], "doc long, text string").write.parquet(f"{tmp_path}/docs")
    words = ["one", ", two", "three four five six seven", "five six seven eight", "x-ray", "ray é", "ré", "six sev"]
    known = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "phrase string, key int")
    got = phrases.scan(spark.read.parquet(f"{tmp_path}/docs"), known, part_phrases=2)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 5, 8, 0), (1, 14, 39, 2), (2, 0, 5, 4)]


def test_phrase_scan_with_a_hundred_thousand_phrases(spark):
    words = [f"w{n}" for n in range(400)]
    known = spark.range(100_000).selectExpr("concat('w', id % 400, ' w', id div 400, ' w', id % 7) as phrase", "id as key")
    text = " ".join(f"w{n % 400} w{n // 400} w{n % 7}." for n in range(0, 100_000, 5000))
    got = phrases.scan(spark.createDataFrame([(1, text)], "doc long, text string"), known).collect()
    assert [r.key for r in sorted(got, key=lambda r: r.start)] == list(range(0, 100_000, 5000)) and words


# Filters that give way


def test_filters_give_way_each_by_itself(spark):
    for on in itertools.product([True, False], repeat=3):
        # Filter i passes rows 0 and 1 if it shall count, else none of what is left.
        rows = spark.createDataFrame([(n, *(n in (0, 1, i + 2) if f else (n == 9 and i > 0) for i, f in enumerate(on))) for n in range(10)], "n int, f0 boolean, f1 boolean, f2 boolean")
        got = {r.n for r in kept(rows, F.col("f0"), F.col("f1"), F.col("f2")).collect()}
        left = set(range(10))
        for i in range(3):
            passing = {r.n for r in rows.filter(f"f{i}").collect()} & left
            left = passing or left
        assert got == left
    empty = spark.createDataFrame([], "n int, f0 boolean")
    assert kept(empty, F.col("f0")).collect() == []


# Keyed tables


def keyed(spark):
    return KeyedTable(spark, new_path(spark, "keyed-test"), spark.createDataFrame([], "id long, v string, w double").schema, "id", buckets=4)


def rows(spark, *found):
    return spark.createDataFrame(list(found), "id long, v string, w double")


def test_keyed_table_changes(spark):
    t = keyed(spark)
    assert t.read().collect() == []
    c = t.upsert(rows(spark, (1, "a", 1.0), (2, "b", None), (2, "c", None), (3, None, None), (None, "x", 1.0)))
    assert (c.added, c.updated, c.unchanged, c.deleted, c.total) == (3, 0, 0, 0, 3)
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 1.0), (2, "c", None), (3, None, None)]
    version = t._manifest()
    c = t.upsert(rows(spark, (1, "a", 1.0), (3, None, None)))
    assert (c.unchanged, c.added, c.updated) == (2, 0, 0) and t._manifest() == version  # nothing was written
    c = t.upsert(rows(spark, (3, "now", 2.0), (4, "d", 0.0)))
    assert (c.added, c.updated, c.total) == (1, 1, 4)
    touched = [b for b, f in t._manifest()[1].items() if version[1].get(b) != f]
    assert 1 <= len(touched) <= 2
    c = t.delete(rows(spark, (1, None, None), (3, None, None), (77, None, None), (None, None, None)).select("id"))
    assert (c.deleted, c.total) == (2, 2) and t.delete(rows(spark, (1, None, None)).select("id")).deleted == 0
    assert sorted(map(tuple, t.read().collect())) == [(2, "c", None), (4, "d", 0.0)]
    assert t.delete(t.read().select("id")).total == 0 and t.upsert(rows(spark, (9, "z", 1.0))).total == 1


def test_keyed_table_survives_a_crash_before_the_manifest(spark, monkeypatch):
    t = keyed(spark)
    t.upsert(rows(spark, (1, "a", 1.0), (2, "b", 2.0)))
    before = sorted(map(tuple, t.read().collect()))

    def crash(*_):
        raise OSError("lost the driver")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", crash)
        with pytest.raises(OSError, match="lost"):
            t.upsert(rows(spark, (1, "new", 1.0), (5, "e", 1.0)))
    again = KeyedTable(spark, t.path, t.schema, "id", buckets=4)
    assert sorted(map(tuple, again.read().collect())) == before
    c = again.upsert(rows(spark, (1, "new", 1.0), (5, "e", 1.0)))
    assert (c.added, c.updated, c.total) == (1, 1, 3)


def test_keyed_table_refuses_a_change_that_came_second(spark):
    t = keyed(spark)
    t.upsert(rows(spark, (1, "a", 1.0)))
    version, folders = t._manifest()
    t.upsert(rows(spark, (2, "b", 1.0)))
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        t._publish(version, folders)


# Differences


def test_differences_of_nested_records(spark):
    def flat(v, path=""):
        if isinstance(v, dict) and (v or not path):
            return {k: x for name, value in v.items() for k, x in flat(value, f"{path}.{name}" if path else name).items()}
        return {path: v}

    states = [{"a": 1, "b": {"c": [1, 2], "d": None}}, {"a": 1, "b": {"c": [1, 2], "d": {"e": "x"}}}, {"a": "1", "b": 5, "new": True}, {"a": "1", "b": 5, "new": True}, {}, {"b": {}}]
    rows = [(1, n, json.dumps(s)) for n, s in enumerate(states, 1)] + [(2, 1, "no json"), (2, 2, '{"k": 1}'), (3, 1, None), (3, 2, "[1]")]
    got = {}
    for r in diffs.changes(spark.createDataFrame(rows, "doc long, n int, state string")).collect():
        got.setdefault((r.doc, r.n), {})[r.path] = tuple(None if x is None else json.dumps(json.loads(x)) for x in (r["from"], r["to"]))
    want = {}
    for n in range(2, len(states) + 1):
        a, b = flat(states[n - 2]), flat(states[n - 1])
        moved = {k: (json.dumps(a[k]) if k in a else None, json.dumps(b[k]) if k in b else None) for k in a.keys() | b.keys() if (k in a, a.get(k)) != (k in b, b.get(k)) or json.dumps(a.get(k)) != json.dumps(b.get(k))}
        if moved:
            want[1, n] = moved
    want[2, 2] = {"k": (None, "1")}
    assert got == want


# Batches


def greedy(sections, max_tokens, max_items):
    """sections: [(overhead, [cost])] -> batches of (section, item) by the rule, in one piece."""
    pieces = []
    for s, (overhead, costs) in enumerate(sections):
        if len(costs) <= max_items and overhead + sum(costs) <= max_tokens:
            pieces.append((overhead + sum(costs), [(s, i) for i in range(len(costs))]))
            continue
        open_, used = [], overhead
        for i, c in enumerate(costs):
            if open_ and (len(open_) >= max_items or used + c > max_tokens):
                pieces.append((used, open_))
                open_, used = [], overhead
            open_, used = [*open_, (s, i)], used + c
        pieces.append((used, open_))
    batches = []
    count = used = None
    for cost, piece in pieces:
        if not batches or count + len(piece) > max_items or used + cost > max_tokens:
            batches.append([])
            count = used = 0
        batches[-1] += piece
        count, used = count + len(piece), used + cost
    return batches


def test_batches_equal_the_greedy_rule(spark):
    rng = random.Random(8)
    docs = {d: [(rng.randrange(5, 20), [rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))]) for _ in range(rng.randrange(1, 15))] for d in range(25)}
    found = [(d, f"s{s:03d}", 1000 * s + i, c, o) for d, sections in docs.items() for s, (o, costs) in enumerate(sections) for i, c in enumerate(costs)]
    got = batching.plan(spark.createDataFrame(found, "doc int, section string, at long, cost long, overhead long"), 100, 5).collect()
    for d, sections in docs.items():
        mine = sorted((r.batch, int(r.local[1:]), r.section, r.at) for r in got if r.doc == d)
        want = [(b, n, f"s{s:03d}", 1000 * s + i) for b, batch in enumerate(greedy(sections, 100, 5)) for n, (s, i) in enumerate(batch, 1)]
        assert mine == want
    with pytest.raises(ValueError, match="positive"):
        batching.plan(spark.createDataFrame(found, "doc int, section string, at long, cost long, overhead long"), 0, 5)


def test_a_section_of_a_million_rows_is_folded_in_batches(spark):
    many = spark.range(1_000_000).selectExpr("1 as doc", "'s' as section", "id as at", "10L as cost", "3L as overhead")
    got = batching.plan(many, 103, 50).groupBy().agg(F.max("batch").alias("b"), F.count_distinct("piece").alias("p"), F.max(F.substring("local", 2, 9).cast("int")).alias("l")).first()
    assert (got.b, got.p, got.l) == (99_999, 100_000, 10)


def test_batches_of_items_dealt_by_document_exchange_nothing(spark):
    items = shared.dealt(spark.range(200).selectExpr("id % 9 as doc", "cast(id % 4 as string) as section", "id as at", "id % 50 + 1 as cost", "3L as overhead"), "doc")
    assert _exchanges(running(items, "doc", ["at"], ["cost"], lambda: 0, lambda s, v: (s + v, s), "before")) == 0
    planned = batching.plan(items, 100, 5)
    assert planned.count() == 200 and _exchanges(planned.groupBy("doc", "batch").count()) == 0  # kept by document
    shared.undealt(items, planned)


def test_running_folds_in_order_within_groups(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 5), ("b", 1, 7), ("a", 2, None), (None, 1, 2)], "g string, o int, v int").repartition(4)
    got = running(df, "g", ["o"], ["v"], lambda: 0, lambda s, v: (s + (v or 0), s), "before")
    assert sorted(map(repr, got.select("g", "o", "before").collect())) == sorted(map(repr, spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 5), ("b", 1, 0), (None, 1, 0)], "g string, o int, before long").collect()))


def test_preview_and_costs(spark):
    r = spark.createDataFrame([(" ".join("w" * 20), None, "", "abcdefgh")], "a string, b string, c string, d string")
    x = r.select(batching.preview(F.col("a")), batching.paragraph_cost(*map(F.col, "abcd")), batching.section_cost(F.col("b"), F.col("d"))).first()
    assert x[0].count("w") == 15 and x[1] == 9 + 1 + 1 + 2 + 12 and x[2] == 1 + 2 + 8
