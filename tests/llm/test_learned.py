"""Quality classifier, centroid clustering and spelling variants against brute force, and on edge cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parchment.llm import classifier, clusters, queries, spelling, topk

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = "[A-Za-zÀ-ÿ]+"


def table(sf, name, *columns):
    return list(zip(*(pq.read_table(f"{sf}/{name}.parquet")[c].to_pylist() for c in columns), strict=True))


# Quality classifier


def plain_fit(rows):
    """(stats, label, fold) rows -> (mean, spread, weights, places, counts and levels of the bins), in one piece."""
    x, y, fold = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = classifier.cosines(x, mean, spread)

    def ridge(on):
        return np.linalg.solve(z[on].T @ z[on] + classifier.RIDGE * np.eye(z.shape[1]), z[on].T @ y[on])

    raw = np.empty(len(y))
    for f in range(classifier.FOLDS):
        raw[fold == f] = z[fold == f] @ ridge(fold != f)
    step = (classifier.MOST - classifier.LEAST) / classifier.BINS
    place = np.clip(np.floor((raw - classifier.LEAST) / step), 0, classifier.BINS - 1)
    at = classifier.LEAST + (place + 0.5) * step
    # The isotonic fit by its min-max formula.
    xs = sorted(set(at))
    good, n = [y[at == v].sum() for v in xs], [(at == v).sum() for v in xs]
    level = [max(min(sum(good[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    return mean, spread, ridge(np.full(len(y), True)), np.array(xs), np.array(n), np.round(level, 12)


def test_quality_scores_equal_a_fit_in_one_piece(spark):
    labels = dict(table(SF, "labels", "doc_id", "quality"))
    docs = table(SF, "documents", "doc_id", "text")
    learned = [(i, t) for i, t in docs if i in labels and zlib.crc32(str(i).encode()) % 5]
    folds = {r.key: r.fold for r in spark.createDataFrame([(i,) for i, _ in learned], "key long").select("key", F.pmod(F.xxhash64("key"), F.lit(classifier.FOLDS)).alias("fold")).collect()}
    mean, spread, weights, xs, n, level = plain_fit([(classifier.describe(t), labels[i], folds[i]) for i, t in learned])
    got = {r.doc_id: r for r in queries.op11_quality_scores(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        raw = float((classifier.cosines(np.array([classifier.describe(t)]), mean, spread) @ weights)[0])
        blocks = [(np.average(xs[level == u], weights=n[level == u]), u) for u in sorted(set(level))]
        calibrated = np.interp(raw, *zip(*blocks, strict=True))
        order = classifier.ORDER_SHARE * np.clip((raw - classifier.LEAST) / (classifier.MOST - classifier.LEAST), 0, 1)
        assert got[i].score == pytest.approx((1 - classifier.ORDER_SHARE) * calibrated + order, abs=1e-5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(got[i].score >= 0.3) and 0 <= got[i].score <= 1


def test_quality_scores_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = spark.createDataFrame(table(sf, "labels", "doc_id", "quality"), "doc_id long, quality int").join(queries.op11_quality_scores(spark, sf).filter("held_out"), "doc_id").collect()
    good, bad = [[r.score for r in got if r.quality == q] for q in (1, 0)]
    assert len(good) > 500 and len(bad) > 50
    assert np.mean([(np.array(good) > b).mean() + (np.array(good) == b).mean() / 2 for b in bad]) > 0.99
    assert np.mean([r.predicted == r.quality for r in got]) > 0.98
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.99


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 5, 12)
        good = rng.binomial(n, np.linspace(0.2, 0.8, 12))
        at, level = classifier.isotonic(np.arange(12.0), good, n)
        want = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(sorted(set(np.round(level, 9))), sorted(set(np.round(want, 9))))
        assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all()


def test_statistics_by_hand():
    d = dict(zip(classifier.STATISTICS, classifier.describe("The cat, the cat.\nThe cat, the cat.\n# 12"), strict=True))
    assert d["words"] == pytest.approx(math.log1p(10)) and d["distinct_share"] == 4 / 10 and d["top_word_share"] == 4 / 10
    assert d["stop_word_share"] == 4 / 10 and d["dup_line_share"] == 1 / 3 and d["repeat_next_share"] == 0
    assert classifier.describe(None) == classifier.describe(" \n ") == [0.0] * len(classifier.STATISTICS)
    assert dict(zip(classifier.STATISTICS, classifier.describe("a a a"), strict=True))["repeat_next_share"] == 2 / 3


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 200_000), (4, "w"), (4, "w"), (None, "w"), (5, "good text, of words")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as stats", "'x' as score", "0 as label")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.classify(docs, none, F.lit(True)).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    known = spark.createDataFrame([(5, 1), (4, 0), (4, 0), (None, 1), (3, None), (2, 7), (99, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, known, F.lit(True)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.id].add((r.score, r.predicted))
    assert len(got) == 7 and by[4] == by[None] and len(by[4]) == 1 and by[1] == by[2]
    one = classifier.classify(docs, known.filter("quality = 1"), F.lit(True)).collect()
    assert all(r.score > 0.98 and r.predicted == 1 for r in one)
    assert classifier.classify(docs.limit(0), known, F.lit(True)).collect() == []


# Centroid clustering


def plain_lloyd(rows, k, rounds):
    """(id, [int]) rows -> [(id, cluster, distance)], centroids."""
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, c), (_, v) in zip(assign(), rows, strict=True):
            groups[c].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centroids)]
    return [(i, c, d) for (i, _), (d, c) in zip(rows, assign(), strict=True)], centroids


def by_text(rows):
    return sorted(map(repr, rows))


def test_clusters_equal_sql_and_brute_force(spark):
    df = queries.op12_clusters(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_clusters"])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in df.select(columns).collect()]
    assert by_text(got) == by_text(want.fetchall())
    rows = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v in table(SF, "embeddings", "vec_id", "embedding") if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    plain, centroids = plain_lloyd(rows, 40, 5)
    assert by_text(tuple(r) for r in df.select("vec_id", "cluster", "distance").collect()) == by_text(plain)
    assert {r.cluster: r.centroid_sha256 for r in df.collect()} == {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for _, c, _ in plain}


def test_clusters_ties_repeats_negatives_and_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [int(x) for x in rng.integers(-3, 3, 3)]) for i in range(300)]
    rows += [rows[7], (None, [1, -1, 0]), (2**60 + 1, [2, 2, 2])]
    vectors = spark.createDataFrame([*rows, (5, None)], "id long, weights array<long>").selectExpr("*", "1 as cluster", "'x' as distance").repartition(5)
    got, centroids = clusters.lloyd(vectors, 12, 4, "2")
    want, plain = plain_lloyd(rows, 12, 4)
    assert centroids.tolist() == plain
    assert by_text(tuple(r) for r in got.select("id", "cluster", "distance").collect()) == by_text(want)
    total = collections.Counter()
    for _, c, d in want:
        total[c] += d
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in got.collect()} == {(c, total[c], sum(total.values())) for c in {c for _, c, _ in want}}


def test_clusters_of_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "id long, weights array<long>")
    got, centroids = clusters.lloyd(empty, 3, 2, "2")
    assert got.collect() == [] and len(centroids) == 0
    two = spark.createDataFrame([(1, [0, 0]), (2, [5, 5])], "id long, weights array<long>")
    got, centroids = clusters.lloyd(two, 40, 5, "2")
    assert len(centroids) == 2 and sorted(r.distance for r in got.collect()) == [0, 0]
    with pytest.raises(Exception, match="component"):
        clusters.lloyd(spark.createDataFrame([(1, [2**40])], "id long, weights array<long>"), 1, 1, "2")


def test_clusters_leave_out_bad_vectors(spark, tmp_path):
    good = [0.5] * 64
    rows = [(1, good), (2, good[:63]), (3, None), (4, [*good[:63], None]), (5, [*good[:63], float("nan")]), (6, [*good[:63], float("-inf")]), (7, [-0.001] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_clusters(spark, str(tmp_path)).collect()
    assert {(r.vec_id, r.distance) for r in got} == {(1, 0), (7, 0)}
    assert topk.whole_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).filter("id = 7").first().weights == [-1] * 64


# Spelling variants


def plain_counts(docs):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall(LETTERS, text or ""):
            run = run.translate(UPPER_TO_LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain_variants(counts, times=2):
    """Near words through the words with one letter left out."""
    short = collections.defaultdict(set)
    near = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            short[(less, i)].add(w)
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    for group in short.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n and counts[best] > n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, form[w], counts.get(form[w]), len(near[w]), root)
    return out


def found(rows):
    return {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in rows}


@pytest.mark.parametrize("sf", [SF, SF_MORE])
def test_spelling_equals_brute_force(spark, sf):
    rows = queries.op13_spelling(spark, sf).collect()
    want = plain_variants(plain_counts(table(sf, "documents", "doc_id", "text")))
    assert len(rows) == len(want) and found(rows) == want
    assert sum(v[1] is not None for v in want.values()) > 50


@pytest.mark.parametrize("group", [1, 60, 400_000])
def test_near_words_in_groups_of_any_size(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "BLOCK", group)
    rng = np.random.default_rng(6)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 8))) for _ in range(1500)} | {"a" * n for n in range(1, 40)} | {"\U0001f600x", "x", "x\U0001f601", "prefix" * 40, "prefix" * 40 + "x"}
    counts = {w: int(rng.integers(1, 200)) for w in sorted(words)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 as width", "2 as head", "3 as form").repartition(7))
    assert found(got.collect()) == plain_variants(counts)


def test_wavelet_tree_reports_every_point():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 64, 65, 300):
        points = rng.permutation(n)
        tree = spelling.WaveletTree(points)
        box = np.sort(rng.integers(0, n + 1, (200, 2)), 1), np.sort(rng.integers(0, n + 1, (200, 2)), 1)
        which, value = tree.report(box[0][:, 0], box[0][:, 1], box[1][:, 0], box[1][:, 1])
        want = sorted((q, int(v)) for q in range(200) for v in points[box[0][q, 0] : box[0][q, 1]] if box[1][q, 0] <= v < box[1][q, 1])
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == want


def test_spelling_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "12 ?!"), (None, "Wörter WÖRTER wÖrter " * 2), (4, "letter " * 50_000), (4, "letter"), (5, "lettex lettex lettex abcd abcd abcd"), (6, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as word", "3 as n")
    counted = spelling.counted_words(df, LETTERS, every=97)
    assert {r.word: r.n for r in counted.collect()} == plain_counts(docs)
    assert found(spelling.variants(counted).collect()) == plain_variants(plain_counts(docs))
    assert spelling.variants(spelling.counted_words(df.limit(0), LETTERS)).collect() == []
    some = spelling.variants(spark.createDataFrame([(None, 3), ("", 1), ("a", 1), ("b", None)], "word string, n long"))
    assert sorted((r.word, r.n_near, r.root) for r in some.collect()) == [("", 1, ""), ("a", 1, "a")]


# Queries against their SQL


@pytest.mark.parametrize("name", ["op2_quality", "op13_spelling"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns) and by_text(tuple(r) for r in df.select(columns).collect()) == by_text(want.fetchall())
