"""Exact selection by rank without gathering the values (AG11).

The rows between two bounds are counted into bins cut at estimated quantiles; a
prefix sum over the bins' exact counts tells which one holds the wanted rank, and
the search goes on inside it.  Each round is one partial aggregate that keeps about
one row in ``BINS``; values that fill a bin by themselves are counted apart, so ties
of any size end the search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 200
FEW = 10_000             # values that are looked at one by one, at most


def _inside(x: Column, low, high) -> Column:
    keep = x.isNotNull()
    if low is not None:
        keep = keep & (x > F.lit(low))
    return keep if high is None else keep & (x <= F.lit(high))


def kth_smallest(df: DataFrame, col: str, k: int) -> tuple[float, int]:
    """The value of rank ``k`` (from 1) among the values of ``col``, and how many values
    are not above it.  Null and NaN are no values."""
    values = df.select(F.col(col).cast("double").alias("x")).where(~F.isnan("x"))
    x, low, high, below = F.col("x"), None, None, 0        # low < x <= high; ``below`` values are not above low
    while True:
        rows = values.where(_inside(x, low, high))
        n, cuts = rows.agg(F.count(x), F.percentile_approx(x, [i / BINS for i in range(1, BINS)], 10 * BINS)).first()
        if n <= FEW:
            for value, count in sorted((r["x"], r["n"]) for r in rows.groupBy("x").agg(F.count("*").alias("n")).collect()):
                below += count
                if below >= k:
                    return value, below
            raise ValueError(f"rank {k} of {below} values")
        edges = sorted(set(cuts))
        for i, (count, equal) in enumerate(_histogram(rows, edges)):
            if below + count < k:
                below += count
                continue
            if i < len(edges) and below + count - equal < k:
                return edges[i], below + count             # the bin's upper edge holds the rank itself
            low = edges[i - 1] if i else low
            high = math.nextafter(edges[i], -math.inf) if i < len(edges) else high
            break


def _histogram(rows: DataFrame, edges: list[float]) -> list[tuple[int, int]]:
    """For each bin (up to and with its edge; the last beyond all edges): values in it and
    values equal to its edge."""
    x, cut = F.col("x"), F.array(*[F.lit(e) for e in edges])
    bin_ = F.size(F.filter(cut, lambda e: e < x))
    counted = rows.groupBy(bin_.alias("bin"), F.array_contains(cut, x).alias("edge")).agg(F.count("*").alias("n")).collect()
    out = [[0, 0] for _ in range(len(edges) + 1)]
    for r in counted:
        out[r["bin"]][0] += r["n"]
        if r["edge"]:
            out[r["bin"]][1] += r["n"]
    return [tuple(v) for v in out]


def exact_median(df: DataFrame, col: str) -> tuple[int, float | None]:
    """Count of the values of ``col`` and their exact median (mean of the middle two for an
    even count; None without values)."""
    x = F.col(col).cast("double")
    df = df.where(~F.isnan(x))
    n = df.agg(F.count(x)).first()[0]
    if n == 0:
        return 0, None
    value, upto = kth_smallest(df, col, (n + 1) // 2)
    if n % 2 == 1 or upto > n // 2:
        return n, value
    return n, (value + df.where(x > F.lit(value)).agg(F.min(x)).first()[0]) / 2
