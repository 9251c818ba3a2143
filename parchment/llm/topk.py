"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Rows of a block of queries and of candidates: a task holds QUERIES * TILE scores at once.
QUERIES, CANDIDATES, TILE = 1024, 8192, 2048


def _postings(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all weights that are not 0."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    on = values != 0
    return row[on], term[on], values[on]


def accumulate(queries: pa.ListArray, candidates: pa.ListArray) -> np.ndarray:
    """Scores of all queries (rows) with all candidates: term by term, a query's weight times the term's postings is added to its dense array.

    Sums are exact: 32-bit numbers where no sum can leave their range, else 64-bit.
    """
    qr, qt, qw = _postings(queries)
    cr, ct, cw = _postings(candidates)
    shape = len(queries), len(candidates)
    if not len(qw) or not len(cw):
        return np.zeros(shape, np.int64)
    terms = int(max(qt.max(), ct.max())) + 1
    most = float(np.abs(qw).max()) * float(np.abs(cw).max()) * terms
    kind = np.int32 if most < 2**31 else np.int64
    by_term = np.argsort(ct, kind="stable")
    ends = np.searchsorted(ct[by_term], np.arange(terms + 1))
    weights = np.zeros((terms, shape[0]), kind)
    weights[qt, qr] = qw
    scores = np.zeros(shape, kind)
    for at in range(0, shape[1], TILE):
        tile = scores[:, at : at + TILE]
        for t in range(terms):
            asked = np.flatnonzero(weights[t])
            mine = by_term[ends[t] : ends[t + 1]]
            rows = cr[mine]
            a, b = np.searchsorted(rows, (at, at + TILE))
            if not len(asked) or a == b:
                continue
            post, where = cw[mine[a:b]].astype(kind), rows[a:b] - at
            if 2 * len(where) > tile.shape[1]:
                dense = np.zeros(tile.shape[1], kind)
                dense[where] = post
                if len(asked) == shape[0]:
                    tile += weights[t][:, None] * dense
                else:
                    tile[asked] += weights[t][asked, None] * dense
            else:
                tile[np.ix_(asked, where)] += weights[t][asked, None] * post
    return scores.astype(np.int64)


def top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) of the k best of each query, ties to smaller ids, its own id left out. ids must rise."""
    least = np.iinfo(np.int64).min
    mine = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    out_q, out_c = [], []
    for q, (row, a, b) in enumerate(zip(scores, *mine, strict=True)):
        row[a:b] = least
        n = min(k, len(row) - (b - a))
        if n <= 0:
            continue
        edge = np.partition(row, len(row) - n)[len(row) - n]
        sure, tied = np.flatnonzero(row > edge), np.flatnonzero(row == edge)
        if edge == least:
            tied = np.setdiff1d(tied, np.arange(a, b))
        best = np.concatenate((sure, tied[: n - len(sure)]))
        out_q.append(np.full(len(best), q)), out_c.append(best)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(out_q or empty), np.concatenate(out_c or empty)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score of each query's k best candidates; both tables are (id long, weights array<long>).

    The query set is scored against all candidates in blocks: pairs of a block of queries and one of candidates are dealt
    out as groups of bounded size, each gives k rows a query, and these are merged by rank. A candidate with the query's
    id is left out. Vectors of different lengths meet in the terms they share; a null vector or id takes no part. Rows
    that repeat an id each count. If a query has fewer candidates, it gets all; if none, no row.
    """
    queries = stash(queries.filter("id is not null and weights is not null").select("id", "weights"))
    candidates = stash(candidates.filter("id is not null and weights is not null").select("id", "weights"))
    q_blocks, c_blocks = max(1, -(-queries.count() // QUERIES)), max(1, -(-candidates.count() // CANDIDATES))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.monotonically_increasing_id() % 1024, F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", deal(q_blocks, 1)).withColumn("cb", every(c_blocks))
    right = candidates.withColumn("cb", deal(c_blocks, 2)).withColumn("qb", every(q_blocks))

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        c = c.sort_by("id")
        own, ids = q["id"].to_numpy(), c["id"].to_numpy()
        column = lambda t: t["weights"].combine_chunks()
        scores = accumulate(column(q), column(c))
        at_q, at_c = top(scores.copy(), ids, own, k)
        return pa.table([pa.array(own[at_q]), pa.array(ids[at_c]), pa.array(scores[at_q, at_c])], schema=schema)

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(score, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def whole_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, weights): floor(scale * component) of each vector, as double; null where the vector or a component is null or not finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    weights = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col(id).cast("long").alias("id"), F.when(finite, weights).alias("weights"))
