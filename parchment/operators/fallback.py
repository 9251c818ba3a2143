"""Filters that give way where they would leave nothing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(rows: DataFrame, *filters: Column) -> DataFrame:
    """rows that pass the filters, one after the other, each of which counts only if it leaves something of what the ones before it left.

    One aggregate tells which sets of filters some row passes together; its one row, joined to all, decides. So the choice is part of the
    plan, and no action runs here. There are 2 ** len(filters) sets: a handful of filters. A null filter value does not pass.
    """
    passes = [F.coalesce(f, F.lit(False)) for f in filters]
    sets = [s for k in range(1, len(filters) + 1) for s in combinations(range(len(filters)), k)]

    def all_of(indices: tuple[int, ...]) -> Column:
        out = F.lit(True)
        for i in indices:
            out = out & passes[i]
        return out

    found = rows.agg(*[F.coalesce(F.bool_or(all_of(s)), F.lit(False)).alias("_any_" + "_".join(map(str, s))) for s in sets])
    counts: list[Column] = []  # whether each filter counts, given which before it do
    for i in range(len(filters)):
        on = F.lit(False)
        for before in (s for k in range(i + 1) for s in combinations(range(i), k)):
            state = F.lit(True)
            for j in range(i):
                state = state & (counts[j] if j in before else ~counts[j])
            on = on | (state & F.col("_any_" + "_".join(map(str, (*before, i)))))
        counts.append(on)
    chosen = found.select(*[c.alias(f"_on_{i}") for i, c in enumerate(counts)])
    test = F.lit(True)
    for i, p in enumerate(passes):
        test = test & (~F.col(f"_on_{i}") | p)
    return rows.crossJoin(F.broadcast(chosen)).filter(test).select(*[rows[c] for c in rows.columns])
