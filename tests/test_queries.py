"""Every query of the catalog against its SQL at the smallest size."""

import duckdb
import pytest

from parchment.operators.reconcile import reconcile
from parchment.operators.retrieval import bm25
from parchment.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, int | str | None) else str(v)


def rows(columns, found):
    order = sorted(columns)
    return sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, want.fetchall())


def test_reconcile_buckets(spark):
    known = spark.createDataFrame([(1, "f", "a", 1, False), (2, "f", "b", 1, False), (3, "f", "c", 1, True), (4, "f", "d", 1, False), (5, "f", "e", 1, True), (6, "f", None, 1, False)], "id long, folder string, name string, stamp int, deleted boolean")
    seen = spark.createDataFrame([(1, "f", "a", 1), (2, "g", "x", 2), (3, "f", "c", 1), (6, "g", None, 1), (7, "f", "n", 1)], "id long, folder string, name string, stamp int")
    got = dict(reconcile(seen, known).collect())
    assert got == {1: "unchanged", 2: "renamed", 3: "restored", 4: "deleted", 5: "absent", 6: "moved", 7: "created"}


def test_bm25_repeated_query_word_counts_twice(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, None), (4, "green")], "id long, text string")
    once, twice = (dict(bm25(docs, q, "id", "text").collect()) for q in ("fox", "fox Fox"))
    assert twice[1] == pytest.approx(2 * once[1]) and once[2] == once[3] == 0.0
