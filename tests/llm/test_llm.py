"""Operators of the llm subpackage against brute force and libraries, and on edge cases."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parchment.llm import chat, html, langid, licenses, neardup, packing, passages, quality, queries, topk

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "word"), (None, "word"), (6, "a b " * 3000), (7, "éß \U0001f600 x")]


@pytest.fixture(scope="session")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    return df.selectExpr("*", "'en' as lang", "1 as id", "'x' as kept", "2 as component", "3L as n", "4 as key")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_near_duplicates_equal_brute_force(spark, docs):
    sets = {i: shingles(t, 4) for i, t in docs.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in by[x])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            by[x].append(i)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_near_duplicates(spark, SF).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_in_a_bucket_of_several_clusters(spark, monkeypatch):
    signatures = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda *a: signatures(*a).withColumn("keys", F.when(F.col("keys").isNotNull(), F.array_repeat(F.lit(1).cast("long"), 2 * neardup.KEYS))))
    rng = np.random.default_rng(3)
    new = lambda: [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows, first = [(0, " ".join(new()))], {0: 0}
    for n in [100] + [2] * 12:  # the first member is unlike all others, and clusters join while the bucket is compared
        base, least = new(), len(rows)
        for k in range(n):
            first[len(rows)] = least
            rows.append((len(rows), " ".join([*base[:-1], f"x{k}"])))
    got = {r.doc_id: r.component for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == first


def test_near_duplicates_edge_cases(edge):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component, r.kept) for r in neardup.near_duplicates(edge).collect())
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1
    assert got[(4, 1, 4, True)] == 2 and got[(5, 1, 4, False)] == 1 and got[(None, 1, None, True)] == 1
    assert neardup.near_duplicates(edge.limit(0)).count() == 0


def test_quality_counts(spark, docs):
    for r in queries.op2_quality(spark, SF).collect():
        text = docs[r.doc_id] or ""
        w = WORD.findall(text)
        times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_quality_edge_cases(edge):
    got = quality.quality(edge).select("doc_id", "quality.*").collect()
    assert len(got) == len(EDGE) and all(r.n_words == 0 and not r.kept for r in got if r.doc_id in (1, 2, 3))


def test_language_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_language(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_edge_cases(spark, edge):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(edge.select("doc_id", "text"), langid.train(train)).collect()
    assert len(got) == len(EDGE) and all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3))


def test_bpe_equals_the_tokenizers_library(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    for r in queries.op8_bpe(spark, SF).collect():
        ids = t.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_holds_every_token_once(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    got = queries.op9_packing(spark, SF).collect()
    pieces, bins = collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            r, part = pieces[i][n], ids[at : at + 4096]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1


def test_packing_edge_cases(edge):
    got = packing.pack(packing.pieces(edge, public_tokenizers.path("word_bpe_49k.json")))
    assert got.count() == len(EDGE) + 1 and packing.pack(packing.pieces(edge.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_top_k_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    v = np.floor(256 * np.array(t["embedding"], np.float32).astype(np.float64)).astype(np.int64)
    ids = np.array(t["vec_id"])
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        scores = v @ v[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        want |= {(int(ids[q]), n + 1, int(ids[i]), int(scores[i])) for n, i in enumerate(order)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op5_top_k(spark, SF).collect()} == want


def test_top_k_leaves_broken_vectors_out(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.5])], "vec_id long, embedding array<float>")
    whole = topk.whole_vectors(rows)
    assert sorted(r.id for r in whole.collect() if r.weights is not None) == [0, 4]
    assert [(r.query_id, r.id, r.score) for r in topk.top_k(whole.filter("id < 4"), whole).collect()] == [(0, 4, 256 * 256 + 512 * 128)]
    assert topk.top_k(whole.limit(0), whole).count() == 0


def test_passages_finds_what_was_planted(spark):
    words = lambda seed, n: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))
    shared = words(99, 70)
    rows = [(i, f"{words(i, 80)}\n{shared}\n{words(100 + i, 80)}") for i in range(20)] + [(50, words(50, 200)), (51, None), (52, "")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(1, 20))
    assert all(abs(r.start_word - 80) <= 3 and abs(r.n_words - 70) <= 6 for r in got)
    left = {r.doc_id: r.text for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert shared in left[0] and all(shared not in left[i] for i in range(1, 20)) and left[51] is None and left[50] == rows[20][1]


def test_passages_on_both_sides_of_a_wide_gap(spark):
    words = lambda seed, n: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))
    first, second = words(1001, 400), words(1002, 60)
    rows = [(i, " ".join([words(i, 60), first, words(50 + i, 160), second, words(90 + i, 60)])) for i in range(3)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, round(r.start_word, -1)) for r in got if r.other == 0) == [(1, 60), (1, 620), (2, 60), (2, 620)]
    first, second = words(1003, 300), words(1004, 300)
    rows = [(0, f"{first} {second}"), (1, f"{first} {words(1005, 280)} {second}")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(round(r.start_word, -1) for r in got) == [0, 580]
    assert passages._common([b"a", b"b", b"x", b"c"], [b"a", b"y", b"b", b"c"]) == 3


def _edited(rng, words, share):
    """words with a share of them replaced, dropped or put in, a third each, at random places."""
    kinds = rng.permutation(np.arange(len(words)) < round(share * len(words)))
    out = []
    for w, hit in zip(words, kinds, strict=True):
        kind = rng.integers(3) if hit else 3
        out += [[f"x{rng.integers(10**6)}"], [], [f"x{rng.integers(10**6)}", w], [w]][kind]
    return out


def test_passages_recall_of_short_and_edited_ones(spark):
    rng = np.random.default_rng(5)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 20000, n)]
    rows, kinds = [], {}
    for share in (0.0, 0.05, 0.1, 0.15):
        for n in (55, 65, 80, 100):
            for _ in range(25):
                i, passage = len(rows), new(n)
                rows += [(i, " ".join(new(60) + passage + new(60))), (i + 1, " ".join(new(90) + _edited(rng, passage, share) + new(90)))]
                kinds[i + 1] = share
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.other == r.doc_id - 1}
    assert found <= set(kinds)
    recall = {s: sum(i in found for i, k in kinds.items() if k == s) / 100 for s in set(kinds.values())}
    print(recall)
    assert recall[0.0] == 1 and recall[0.05] >= 0.97 and recall[0.1] >= 0.93 and recall[0.15] >= 0.8


def _uncovered(spark, rows):
    """(doc, place) of words in runs of 50 that an earlier text holds, by brute force, that are in no passage."""
    known, missing = {}, set()
    covered = collections.defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    for i, text in sorted(rows):
        words = text.split()
        runs = [tuple(words[a : a + 50]) for a in range(len(words) - 49)]
        missing.update((i, a + k) for a, run in enumerate(runs) if run in known for k in range(50) if a + k not in covered[i])
        known.update((run, i) for run in runs if run not in known)
    return missing


def test_passages_that_neither_first_nor_last_holders_of_seeds_hold(spark):
    rng = np.random.default_rng(8)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 20000, n)]
    rows = []
    for at in range(0, 40000, 100):
        whole = new(60)
        parts = {5: whole[:40], 6: whole[20:], 10: whole, 15: whole[:40], 16: whole[20:], 20: whole}
        if at % 200:  # the first holder has it twice
            parts[4] = whole[5:45] + new(9) + whole[8:48]
        rows += [(at + i, " ".join(new(40) + part + new(40))) for i, part in parts.items()]
    assert not _uncovered(spark, rows)


def test_passages_cover_every_exact_run(spark):
    rng = np.random.default_rng(9)
    sources = [[f"{s}_{x}" for x in rng.integers(0, 400, 300)] for s in range(6)]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rng.integers(1, 7)):
            source, a = sources[rng.integers(6)], rng.integers(0, 250)
            words += source[a : a + rng.integers(10, 120)] * (1 + (rng.random() < 0.2)) + [f"x{x}" for x in rng.integers(0, 50000, rng.integers(0, 15))]
        rows.append((i, " ".join(w if rng.random() < 0.995 else "y" for w in words)))
    assert not _uncovered(spark, rows)


def test_chat_branches_and_round_trip(spark):
    tree = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 3, 1.0)], "tree long, node long, parent long, score double")
    best = {(r.tree, r.leaf, r.node) for r in chat.branches(tree).collect()}
    assert best == {(1, 4, 1), (1, 4, 3), (1, 4, 4)}
    got = {r.conv_id: r for r in queries.op4_chats(spark, SF).collect()}
    hard = "<|im_end|><|im_start|>assistant ok"
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())


def test_html_rendering(spark):
    rows = spark.createDataFrame([(1, "<p>One<p>Two<ul><li>a<li>b</ul><script>no</script><p hidden>no</p>"), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: r.text for r in html.extract(rows).collect()}
    assert got[1].split("\n\n")[:2] == ["One", "Two"] and "- a\n- b" in got[1] and "no" not in got[1]


def test_license_scan_edge_cases(edge):
    assert licenses.scan(edge).count() == 0


def test_pipeline_is_made_of_its_stages(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "substring dedup", "best-fit packing"]
    kept = {r.doc_id for r in queries.op2_quality(spark, SF).collect() if r.kept}
    assert out and {r.doc_id for r in out} <= kept


def test_chat_cycles_repeats_and_empty_tables(spark):
    kind = "tree long, node long, parent long, score double"
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (2, 1, 2, 0.0), (2, 2, 1, 0.0), (2, 3, 2, 9.0), (3, 1, 1, 0.0), (None, 7, None, None), (None, 7, None, None), (4, 5, 99, 1.0), (4, None, 5, 1.0)]
    got = sorted((str(r.tree), r.leaf, r.node) for r in chat.branches(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", 2, 1), ("1", 2, 2), ("4", 5, 5), ("None", 7, 7)]
    assert chat.branches(spark.createDataFrame([], kind)).count() == 0
    turns = spark.createDataFrame([(1, 1, "user", None), (1, 1, "user", None), (1, 1, "assistant", "x<|im_end|>&lt;"), (2, None, None, "a")], "conv_id long, turn long, role string, text string")
    out = {r.tree: r for r in chat.format_chats(chat.linear(turns)).select("tree", chat.read_turns(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in out[1].t] == [("assistant", "x<|im_end|>&lt;"), ("user", ""), ("user", "")] and out[1].loss == "x<|im_end|>&lt;" and out[2].loss == ""


PAGES = {
    "<table><tr>stray<td>x</td></tr></table>": "stray\nx",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><th>Name<th>Age<tr><td>Al<td>7</table>after": "Name  Age\nAl    7\n\nafter",
    '<ol start="--5"><li>a</ol><ol start="-5"><li>b</ol>': "1. a\n\n-5. b",
    "<p>a &amp; b<!-- no --><br>c</p><div>d</div>e": "a & b\nc\n\nd\ne",
    "<pre>x\n  y</pre>z": "x\n  y\n\nz",
    "<ul><li>a<ul><li>b</ul></ul>": "- a\n  - b",
    "a < b <script>x</script ><span style='display: none'>no</span>c": "a < b c",
    "<p title='a>b'>t": "t",
    "text <a href": "text <a href",
    "<div>" * 300 + "<p>one<p>two": "one\n\ntwo",
    "<table><tfoot><tr><td>foot<tbody><tr><td>a<td colspan=2>bb<td>c<tr><td>x<td>y<td>z<td>w</table>": "a     bb     c\nx     y   z  w\nfoot",
    "<table><tr><td colspan=1000>a<td>b<tr><td colspan=1000>cc<td>d</table>": "a   b\ncc  d",
    "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
}


def test_html_pages_written_by_hand():
    for page, want in PAGES.items():
        assert html.visible_text(page) == want, page


def test_html_takes_time_in_proportion():
    import time

    n = 100_000
    pages = [p * n for p in ('<a "', "<a x", "<!", "<a '>'", "</script", "<script></script", "<div>", "<section>", "<ul><li>a", "<ul><li><div>a", "<p>a", "<td>a", "<li>a")]
    pages += ["<div>" * n + "</b>" * n, "<span>" * n + "<section>a</section>" * n, "<table><tr>" + "<td colspan=1000>a" * n, "<table>" + "<tr><td rowspan=9 colspan=1000>a" * n, "<table><tr><td>x" * 2000]
    for page in pages:
        began = time.time()
        text = html.visible_text(page)
        assert time.time() - began < 20 and len(text) < 10 * len(page), page[:40]


def plain_html(page):
    """Blocks, line breaks, lists and hidden elements by plain recursion over a tree that is built by scanning the whole stack."""
    stack, root = [], html.Node("html", {})
    stack.append(root)
    for kind, tag, rest, text in re.findall(r"<(/?)(\w+)([^>]*)>|([^<]+)", page):
        if text:
            stack[-1].children.append(text)
        elif kind:
            if any(n.tag == tag for n in stack[1:]):
                while stack.pop().tag != tag:
                    pass
        else:
            for ends, shields in ([html.CLOSES[tag]] if tag in html.CLOSES else []) + ([({"p"}, {"td", "th", "table", "button", "div", "li", "blockquote"})] if tag in html.BLOCKS else []):
                inside = len(stack) - next((k for k, n in enumerate(reversed(stack)) if n.tag in shields or n is root), 0)
                found = [k for k in range(inside, len(stack)) if stack[k].tag in ends]
                if found:
                    del stack[found[0] :]
            node = html.Node(tag, {"hidden": ""} if "hidden" in rest else {})
            stack[-1].children.append(node)
            if tag not in html.VOID:
                stack.append(node)

    def show(node, out, keep, tight):
        if isinstance(node, str):
            return out.text(node, keep)
        if "hidden" in node.attributes:
            return None
        if node.tag == "br":
            return out.break_line()
        if node.tag in ("ul", "ol"):
            out.block(1 if tight else 2)
            n = 1
            for c in node.children:
                if isinstance(c, html.Node) and c.tag == "li":
                    if "hidden" in c.attributes:
                        continue
                    inner, mark = html._Out(), f"{n}. " if node.tag == "ol" else "- "
                    n += 1
                    for x in c.children:
                        show(x, inner, keep, True)
                    for k, x in enumerate(inner.done() or [""]):
                        out.text((mark if k == 0 else " " * len(mark)) + x if x or k == 0 else "", True)
                        out.block(1)
                else:
                    show(c, out, keep, True)
            return out.block(1 if tight else 2)
        gap = 2 if node.tag in html.PARAGRAPHS else 1 if node.tag in html.BLOCKS else 0
        if gap:
            out.block(gap)
        for c in node.children:
            show(c, out, keep or node.tag == "pre", tight and not gap)
        return out.block(gap) if gap else None

    out = html._Out()
    for c in root.children:
        show(c, out, False, False)
    return "\n".join(out.done()).strip("\n")


def test_html_equals_a_plain_renderer_on_random_pages():
    rng = np.random.default_rng(9)
    tags = ["p", "div", "ul", "ol", "li", "b", "span", "pre", "br", "h1", "blockquote", "section", "dt", "dd", "span hidden", "li hidden"]
    for _ in range(1000):
        parts = []
        for _ in range(rng.integers(1, 40)):
            tag = tags[rng.integers(len(tags))]
            parts.append([f"<{tag}>", f"</{tag.split()[0]}>", f"w{rng.integers(9)}", " ", "\n x "][rng.integers(5)])
        page = "".join(parts)
        assert html.visible_text(page) == plain_html(page), page


def test_html_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<b>a", None)], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html.extract(rows).collect()) == [(0, "a"), (1, ""), (1, "")]
    assert html.extract(rows.limit(0)).count() == 0


def test_licenses_planted(spark, edge):
    rng, known = np.random.default_rng(4), licenses.templates()
    texts = licenses.TEMPLATES | {f"{p.stem}-text": p.read_text() for p in licenses.LONG_TEXTS.glob("*.txt")}
    rows, want = [], {}
    for t in known:
        for rate in (0.0, 0.05, 0.1):
            words = [w if w in t.named or rng.random() >= rate else "" if rng.random() < 0.5 else "zzz" for w in licenses.words(texts[t.name])]
            want[len(rows)] = t.name
            rows.append((len(rows), " ".join(["some prose here"] * 9 + words + ["and more prose"] * 9)))
    got = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
        assert 0.8 <= r.coverage <= 1
    assert sum(want[i] in got[i] for i in want) >= 0.95 * len(want)
    mit = texts["mit-text"]
    plain = [(1, f"Intro {mit} {mit} outro"), (2, "Released under the BSD License."), (3, "Licensed under CC BY 4.0"), (4, "No license at all, and no software."), (5, None), (5, None)]
    found = sorted((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(plain, "doc_id long, text string")).collect())
    assert found == [(1, "mit-text"), (1, "mit-text"), (2, "bsd"), (3, "cc-by-4.0")]
    assert licenses.scan(edge.limit(0)).count() == 0


def test_packing_against_best_fit_and_the_optimum():
    rng = np.random.default_rng(1)

    def optimum(lengths, size):
        best = [len(lengths)]

        def down(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= size and bins[k] not in bins[:k]:
                    bins[k] += lengths[i]
                    down(i + 1, bins)
                    bins[k] -= lengths[i]
            bins.append(lengths[i])
            down(i + 1, bins)
            bins.pop()

        down(0, [])
        return best[0]

    for _ in range(150):
        size = int(rng.integers(10, 40))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 11)))
        bins = packing.pack_lengths(lengths, size)
        assert sorted(x for b in bins for x in b) == sorted(lengths.tolist()) and max(map(sum, bins)) <= size
        assert len(bins) == optimum(sorted(lengths.tolist(), reverse=True), size) >= packing.bound(lengths, size)
    for n, low, high in ((300, 800, 2000), (2000, 300, 3000), (3000, 1300, 1500)):
        lengths = rng.integers(low, high, n)
        assert packing.bound(lengths, 4096) <= len(packing.pack_lengths(lengths)) <= len(packing.best_fit(lengths, 4096))


def test_passages_of_repeated_ids_other_ids_and_clashing_columns(spark):
    words = lambda seed, n: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))
    shared, own = words(1, 80), words(2, 300)
    rows = [("a", shared, 1, 2), ("b", f"{words(3, 50)} {shared}", 3, 4), ("b", own, 5, 6), (None, shared, 7, 8), ("c", None, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _cut int, id int")
    found = passages.repeated_passages(df).collect()
    assert len(found) == 1 and {found[0].doc_id, found[0].other} == {"a", "b"}
    left = [(r.doc_id, r.text, r["_cut"], r.id) for r in passages.without_repeats(df).collect()]
    assert ("b", own, 5, 6) in left and (None, shared, 7, 8) in left and ("c", None, 9, 9) in left and len(left) in (4, 5)
    assert passages.repeated_passages(df.limit(0)).count() == 0 and passages.without_repeats(df.limit(0)).count() == 0


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == 4 and len({r.component for r in got if r.doc_id == 2}) == 1


def test_bpe_and_packing_of_empty_tables_and_clashing_columns(spark, edge):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from parchment.llm import bpe

    rows = edge.withColumn("ids", F.lit("x")).withColumn("row", F.lit(1))
    got = {(r.doc_id, r.decoded) for r in bpe.recode(rows, path).collect()}
    assert got == {(i, t or "") for i, t in EDGE} and bpe.recode(rows.limit(0), path).count() == 0
    assert bpe.decode(bpe.encode(rows, path), path, into="back").filter("doc_id = 7").first().back == EDGE[-1][1]
    pieces = spark.createDataFrame([(5, 1, 2, 3)] * 3, "length int, _row int, _block int, row int")
    assert {tuple(r)[:4] for r in packing.pack(pieces).collect()} == {(5, 1, 2, 3)}


def test_language_blocks_and_profiles_by_brute_force():
    import random

    random.seed(2)
    for _ in range(200):
        text = "".join(random.choice("ab ΣcÉ\n1.-") for _ in range(random.randrange(0, 60)))
        whole, parts = langid.gram_counts(text), langid.gram_counts(text, block=5)
        assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
        clean = re.sub(" +", " ", f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} ")
        want = collections.Counter(clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1))
        want = {k: n for k, n in want.items() if k != " "} if clean.strip() else {}
        assert sorted(want.values()) == sorted(whole[1].tolist())


def test_quality_verdict_by_its_own_thresholds(spark, docs):
    stop = {w for ws in quality.STOP_WORDS.values() for w in ws}
    for r in queries.op2_quality(spark, SF).collect():
        text = docs[r.doc_id] or ""
        n, lines = max(1, r.n_words), [x for x in text.split("\n") if WORD.search(x)]
        plain = re.split(r"[\x20\x09-\x0D]+", text.lower().translate(str.maketrans(quality.MARKS, " " * len(quality.MARKS))))
        sound = 2 <= r.word_chars / n <= 14 and r.n_symbols / n <= 0.3 and sum(w in stop for w in plain) / n >= 0.02 and r.n_dup_lines / max(1, len(lines)) <= 0.5
        assert r.kept == (not r.base_failed and sound)


def test_pipeline_stages_on_edge_cases(spark):
    rows = [(i, t, "en", "s", 0, "q", "g", 1, 2) for i, t in EDGE] + [(20, " ".join(["the cat is on the mat and it was there with him"] * 1 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]), None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _quality string, _gone string, id int, row int")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best-fit packing":
                assert out.columns == docs.columns
            assert out.count() <= docs.count() + 2


def test_runs_delete_only_their_own_tables(spark):
    import threading

    from parchment.llm import common

    one = lambda n: spark.createDataFrame([(n,)], "n int")
    before = common.stash(one(1))
    other, ready, swept = {}, threading.Event(), threading.Event()

    def beside():
        other["mine"] = common.stash(one(2))
        ready.set()
        swept.wait(60)
        other["rows"] = other["mine"].collect()

    def run():
        older = common.stashed()
        gone = common.stash(one(3))
        ready.wait(60)
        kept = common.stash(one(4))
        common.sweep(kept, older)
        swept.set()
        other["kept"] = kept.collect()
        with pytest.raises(Exception, match="(?i)not exist|not found"):
            gone.collect()

    threads = [threading.Thread(target=t) for t in (beside, run)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert other["rows"][0].n == 2 and other["kept"][0].n == 4 and before.collect()[0].n == 1


def test_pipeline_beside_another_operator(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.submit(lambda: corpus_pipeline.run(spark, SF).count()), pool.submit(lambda: [queries.op9_packing(spark, SF).count() for _ in range(3)])
        assert a.result() > 0 and len(set(b.result())) == 1


def test_passages_runs_around_seeds_are_packed_by_key():
    """_Runs against plain loops, for many seeds and texts at once: one row for runs next to each other with one key."""
    rng = np.random.default_rng(3)
    made, made_of, want = passages._Runs(), {}, []
    for i in range(60):
        q = rng.integers(0, 9, rng.integers(50, 200)).astype(np.uint32)
        shift = int(rng.integers(0, 10))
        p = q[shift:].copy()
        p[rng.integers(0, len(p), 6)] = 99
        for itself in (False, True):
            borders = []
            for a in rng.integers(shift, len(q) - 20, 4).tolist():
                borders += [a, a - shift]
                if a + 32 > len(q):
                    continue
                back = next((k for k in range(min(50, a - shift)) if q[a - 1 - k] != p[a - 1 - k - shift]), min(50, a - shift))
                on = next((k for k in range(min(50, len(q) - a)) if q[a + k] != p[a + k - shift]), min(50, len(q) - a))
                low, high = max(0, a - 18), min(a, len(q) - 50) + 1
                right = max(low, a + on - 49)
                for at, to, first, end in ((low, high, a, a + 32),) if itself else ((right, high, a, a + on + 1), (low, min(right, a - back), a - back - 1, a + 32)):
                    if at < to:
                        want.append((i, at, tuple(q[first:end]), tuple(tuple(q[x : x + 50]) for x in range(at, to))))
            made.add(i, q, borders, itself, [] if itself else [0], [] if itself else [p])
    got = [r for batch in made.batches() for r in batch.select(["id", "start_word", "start_char", "runs"]).to_pylist()]
    assert len(want) > 100 and sorted((r["id"], r["start_word"], len(r["runs"])) for r in got) == sorted((i, at, len(runs)) for i, at, _, runs in want)
    # Equal hashes are of equal words, and the other way round.
    for x in got:
        made_of.setdefault((x["id"], x["start_word"], len(x["runs"])), set()).add((x["start_char"], tuple(x["runs"])))
    for i, at, _, runs in want:
        assert len({runs for _, runs in made_of[(i, at, len(runs))]}) == 1
    hashes = {h for x in got for h in x["runs"]}
    assert len(hashes) == len({run for *_, runs in want for run in runs}) and len({x["start_char"] for x in got}) == len({key for _, _, key, _ in want})


def test_passages_edited_ones_that_neither_first_nor_last_holders_of_seeds_hold(spark):
    rng = np.random.default_rng(18)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 20000, n)]
    rows = []
    for at in range(0, 10000, 100):
        whole = new(70)
        parts = {5: whole[:40], 6: whole[30:], 10: whole, 15: whole[:40], 16: whole[30:], 20: _edited(rng, whole, 0.1)}
        rows += [(at + i, " ".join(new(40) + part + new(40))) for i, part in parts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.other) for r in passages.repeated_passages(df).collect()}
    recall = len(found & {(at + 20, at + 10) for at in range(0, 10000, 100)}) / 100
    left = {r.doc_id: len(r.text.split()) for r in passages.without_repeats(df).collect()}
    print(recall)
    assert recall >= 0.93 and all(i % 100 == 20 and other == i - 10 for i, other in found)
    assert all(left[i] <= 100 for i, other in found)


def test_passages_documents_meet_once_before_their_places(spark):
    rng = np.random.default_rng(21)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 20000, n)]
    stretch, lines = new(40), ["a"] * 30 + ["b"] * 30
    texts = {i: new(60) + stretch + new(60 + i) for i in range(12)} | {i: new(i) + lines + new(40) for i in range(20, 24)}
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "id long, text string")
    links = passages._candidates(rows)[1]
    none = passages.stash(spark.createDataFrame([], "id long, other long, start_word long, n_words long"))
    got = passages._others(rows, links, none).collect()
    pairs = [(r.id, r.other) for r in got]
    assert len(pairs) == len(set(pairs)) and {(i, j) for i in range(3, 12) for j in range(i)} <= set(pairs) and {(23, j) for j in range(20, 23)} <= set(pairs)
    for r in got:
        places = [(m >> 33, (m & 0xFFFFFFFF) >> 1) for m in r.m]
        assert len(places) == len(set(places)) and all(texts[r.id][q : q + 5] == texts[r.other][p : p + 5] for q, p in places)
        kinds = {tuple(texts[r.id][q : q + 5]) for q, _ in places}
        assert len(kinds) > 1 and all(len({x[k] for x in places}) > 1 for k in (0, 1))


def test_passages_documents_without_one_go_before_their_places(spark):
    rng = np.random.default_rng(22)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 20000, n)]
    line, stretch = new(34), new(60)
    texts = {i: new(60) + line + new(60 + i) for i in range(12)} | {i: new(i) + stretch + new(40) for i in range(20, 24)}
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "id long, text string")
    links = passages._candidates(rows)[1]
    none = passages.stash(spark.createDataFrame([], "id long, other long, start_word long, n_words long"))
    pairs = {(r.id, r.other) for r in passages._others(rows, links, none).collect()}
    assert {(23, j) for j in range(20, 23)} <= pairs and min(min(x) for x in pairs) >= 20
    runs = spark.createDataFrame([(11, 4)], "id long, other long")
    assert {(r.id, r.other) for r in passages._others(rows, links, none, runs).collect()} == pairs | {(11, 4)}


def test_passages_lie_only_where_they_may_be():
    """No passage of two texts of few words, many of them in runs, is in stretches that may_hold denies; and thinned matches give the same segments."""
    rng = np.random.default_rng(23)
    held = denied = 0
    for _ in range(150):
        q, p = (np.concatenate([np.repeat(rng.integers(0, 6), n) for n in rng.integers(1, 30, 20)]) for _ in range(2))
        p[:80] = np.where(rng.random(80) < 0.1 * rng.integers(1, 4), 9, q[:80])
        a, x = (i.ravel() for i in np.indices((len(q) - 4, len(p) - 4)))
        same = np.all([q[a + k] == p[x + k] for k in range(5)], axis=0)
        a, x = a[same], x[same]
        row, five = np.zeros(len(a), np.int64), np.full(len(a), 5)
        whole, thin = passages.segments(row, a, x, five), passages.thinned(row, a, x)
        assert len(thin[0]) < len(a) and all(np.array_equal(*i) for i in zip(whole, passages.segments(*thin, five[: len(thin[0])]), strict=True))
        for s in rng.integers(0, len(whole[0]), 15):
            line = [tuple(int(c[s]) for c in whole[1:4])]
            (b, e, y, f, equal), ((u, v, w),) = passages.align(q, p, line), line
            may = passages.may_hold(q[max(0, u - 50) : v + 50].tolist(), p[max(0, w - 50) : w + v - u + 50].tolist())
            good = min(e - b, f - y) >= 50 and equal >= 0.8 * max(e - b, f - y)
            assert may or not good
            held, denied = held + good, denied + (not may)
    assert held > 20 and denied > 20


def test_passages_documents_meet_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(24)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 20000, n)]
    stretch = new(60)
    rows = spark.createDataFrame([(i, " ".join(new(i) + stretch + new(60))) for i in range(20)], "id long, text string")
    none = passages.stash(spark.createDataFrame([], "id long, other long, start_word long, n_words long"))
    made, stash = [], passages.stash
    monkeypatch.setattr(passages, "stash", lambda *x: made.append(len(x)) or stash(*x))
    found = []
    for size in (1 << 18, 1):
        monkeypatch.setattr(passages, "ROUND", size)
        made.clear()
        got = passages._others(rows, passages._candidates(rows)[1], none).collect()
        found.append((made.count(2), sorted((r.id, r.other, sorted(r.m)) for r in got)))
    (once, want), (rounds, same) = found
    assert once == 1 and rounds > 5 and len(want) > 100 and want == same


def test_exchanged_rows_go_when_a_table_is_stashed(spark):
    from parchment.llm import common

    files = lambda: {f for f in map(lambda x: x.getName(), _all_files(spark)) if f.startswith("shuffle_")}
    before = files()
    kept = common.stash(spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5, "k").groupBy("k").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _all_files(spark) -> list:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]
