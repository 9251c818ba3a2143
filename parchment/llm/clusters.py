"""Centroid clustering: plain Lloyd rounds on vectors of integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Weights are below this in size, so that a squared distance of up to 512 components is a long.
LIMIT = 2**26
#: Rows that a task compares at once.
ROWS = 8192


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest index of a nearest centroid, squared distance to it) of each row; exact on integers."""
    found = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        gap = vectors - centroid
        found[:, c] = np.einsum("ij,ij->i", gap, gap)
    best = found.argmin(1)
    return best, found[np.arange(len(vectors)), best]


def _assigned(batches, centroids: np.ndarray):
    """(rows of a batch, their vectors, index, distance), ROWS at a time."""
    for b in batches:
        for at in range(0, len(b), ROWS):
            part = b.iloc[at : at + ROWS]
            vectors = np.stack(part["weights"].to_numpy()).astype(np.int64)
            yield part, vectors, *nearest(vectors, centroids)


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `<salt>:<id>`, in that order; fewer if there are fewer. Equal ids go by their weights."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    found = vectors.filter("id is not null").select(order.alias("h"), "weights").orderBy("h", "weights").limit(k).collect()
    return np.array([r.weights for r in found], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the exact means of their vectors; one without vectors stays.

    Each task sums its vectors by centroid, and these sums, k rows a task, are merged by groupBy. k rows come to the driver.
    """
    n = centroids.shape[1]
    schema = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(n))

    def sums(batches):
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, rows, best, _ in _assigned(batches, centroids):
            np.add.at(total, best, rows)
            count += np.bincount(best, minlength=len(centroids))
        on = np.flatnonzero(count)
        out = pd.DataFrame(total[on], columns=[f"s{i}" for i in range(n)])
        out.insert(0, "cluster", on.astype(np.int32))
        out.insert(1, "n", count[on])
        yield out

    merged = vectors.select("weights").mapInPandas(sums, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    out = centroids.copy()
    for r in merged.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(n)]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def lloyd(vectors: DataFrame, k: int, rounds: int, salt: str) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia) of each vector (id long, weights array<long>), final centroids).

    Weights are integers of size below LIMIT, all vectors as long as each other (else an error). `rounds` times each vector
    goes to its nearest centroid, the lower number if several are as near, and centroids become floors of means; then vectors are assigned once more. Only
    centroids (k vectors) and k sums a round pass the driver; they travel with each task. A hot cluster is summed where its vectors are.
    Null vectors take no part; a null id does, but is never a first centroid. Rows that repeat an id each count. Fewer
    vectors than k give as many centroids; without a vector that has an id the result is empty. Only id and weights are read.
    """
    size = F.lit(LIMIT)
    fits = F.forall("weights", lambda x: F.coalesce((x < size) & (x > -size), F.lit(False)))
    checked = F.when(fits, F.col("weights")).otherwise(F.raise_error(F.lit(f"a component is null, or its size is not below {LIMIT}")))
    vectors = stash(vectors.filter("weights is not null").select(F.col("id").cast("long").alias("id"), checked.alias("weights")))
    centroids, schema = seeds(vectors, k, salt), "id long, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)

    def last(batches):
        for part, _, best, distance in _assigned(batches, centroids):
            yield pd.DataFrame({"id": part["id"], "cluster": best.astype(np.int32), "distance": distance})

    # As text, an id goes through pandas unchanged though others are null.
    named = vectors.withColumn("id", F.col("id").cast("string")).mapInPandas(last, schema.replace("id long", "id string"))
    assigned = stash(named.withColumn("id", F.col("id").cast("long")))
    by_cluster = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = F.element_at(F.create_map(*[F.lit(x) for c, d in by_cluster.items() for x in (c, d)]), F.col("cluster"))
    return assigned.withColumns({"cluster_inertia": of.cast("long"), "inertia": F.lit(sum(by_cluster.values())).cast("long")}), centroids
