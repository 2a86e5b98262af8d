"""Ranks and rank tests of groups of any size: counts of distinct values in ranges, and offsets between ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism, materialize, ship_package
from ..functions.normal import cumulative

EXACT_SIZE, EXACT_PRODUCT = 8, 100_000  # the smaller group, and the pairs, up to which probabilities are counted out


def ranked_values(counts: DataFrame, value: str, by: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """``counts`` (one row per value of a group, with ``n`` of its rows) with ``rank``, the mean rank of the value's rows from 1 on.

    Values are cut into ranges, so that a group with most rows is many tasks: each counts within its range, and starts
    from the rows of the ranges before it. Values are not null.
    """
    ranges = ranges or default_parallelism(counts.sparkSession)
    # written, as the cuts come from a sample
    placed = materialize(counts.repartitionByRange(ranges, *by, value).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(*by, "__range").agg(F.sum("n").alias("__rows"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumn("__upto", F.sum("n").over(inside))
    same = [joined[c].eqNullSafe(offsets[c]) for c in (*by, "__range")]
    out = joined.join(offsets, same).select(*(joined[c] for c in joined.columns), "__before")
    return out.withColumn("rank", F.col("__before") + F.col("__upto") - F.col("n") + (F.col("n") + 1) / 2).drop("__range", "__upto", "__before")


def mean_ranks(df: DataFrame, value: str, by: tuple[str, ...], into: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the mean rank of ``value`` in its group as ``into``; null values have no rank and do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranks = ranked_values(counts, value, by, ranges).select(*(F.col(c).alias(f"__{c}") for c in (*by, value)), F.col("rank").alias(into))
    same = df[value] == ranks[f"__{value}"]
    for c in by:
        same = same & df[c].eqNullSafe(ranks[f"__{c}"])
    return df.join(ranks, same, "left").drop(*(f"__{c}" for c in (*by, value)))


def rank_correlation(df: DataFrame, x: str, y: str, by: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """(by, n, rho): Spearman's correlation of the rows with both values, ties by mean ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = mean_ranks(mean_ranks(both, x, by, "__rx", ranges), y, by, "__ry", ranges)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__rx", "__ry").alias("rho"))


def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """How many of all orders of n1 and n2 different values give each U from 0 to n1 * n2, as exact integers.

    The generating function is the product over i from 1 to n1 of (1 - q^(n2 + i)) / (1 - q^i).
    """
    ways = np.zeros(n1 * n2 + 1, dtype=object)
    ways[:] = 0
    ways[0] = 1
    for i in range(1, n1 + 1):
        step = n2 + i
        if step < len(ways):
            longer = ways.copy()
            longer[step:] -= ways[:-step]
            ways = longer
        for k in range(i):
            ways[k::i] = np.cumsum(ways[k::i])
    return ways


def exact_probability(u: float, n1: int, n2: int, two_sided: bool = True) -> float:
    """P of a U at least as far out as ``u``, above only if not ``two_sided``, from all orders of different values."""
    small, large = sorted((n1, n2))
    ways = rank_sum_counts(small, large)
    total = sum(ways.tolist())
    at = int(max(u, n1 * n2 - u)) if two_sided else int(u)
    above = sum(ways[at:].tolist()) / total
    return min(1.0, 2 * above) if two_sided else above


def _exact(u: Column, n1: Column, n2: Column, two_sided: bool) -> Column:
    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([exact_probability(a, int(b), int(c), two_sided) for a, b, c in zip(u, n1, n2)], dtype=float)

    return p(u, n1, n2)


def rank_sum(df: DataFrame, value: str, group: str, by: tuple[str, ...], two_sided: bool = True, exact: bool = True, ranges: int | None = None) -> DataFrame:
    """Mann-Whitney test of two groups (``group`` true or false): (by, n1, n2, u, p, method).

    ``u`` counts the pairs where the first group is above, ties half. p is counted out where no value repeats and the
    smaller group has at most 8 rows (and there are at most 100,000 pairs), else it comes from the normal approximation
    with ties and continuity. One-sided tests ask whether the first group is above. Null values and groups are left out;
    p is null where one group is empty, and 1 where all values are equal.
    """
    ship_package(df.sparkSession)
    one = F.col(group)
    counts = df.where(F.col(value).isNotNull() & one.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.count(F.when(one, 1)).alias("__first"))
    ranked = ranked_values(counts, value, by, ranges)
    ties = F.col("n").cast("double")
    g = ranked.groupBy(*by).agg(
        F.sum("__first").alias("n1"), F.sum(F.col("n") - F.col("__first")).alias("n2"), F.sum(F.col("rank") * F.col("__first")).alias("__r1"), F.sum(ties**3 - ties).alias("__tie")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    g = g.withColumn("u", F.col("__r1") - n1 * (n1 + 1) / 2)
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("__tie") / (n * (n - 1))))
    off = F.col("u") - n1 * n2 / 2
    z = (F.greatest(F.lit(0.0), F.abs(off) - 0.5) if two_sided else off - 0.5) / F.when(sigma > 0, sigma)
    normal = F.when((n1 > 0) & (n2 > 0), F.coalesce((2 if two_sided else 1) * (1 - cumulative(z)), F.lit(1.0)))
    counted = F.lit(exact) & (F.col("__tie") == 0) & (F.least("n1", "n2").between(1, EXACT_SIZE)) & (F.col("n1") * F.col("n2") <= EXACT_PRODUCT)
    g = g.withColumn("method", F.when(counted, "exact").otherwise("normal")).withColumn("__normal", normal)
    asked = g.where(F.col("method") == "exact")
    out = asked.withColumn("p", _exact(F.col("u"), F.col("n1"), F.col("n2"), two_sided)).unionByName(g.where(F.col("method") == "normal").withColumn("p", F.col("__normal")))
    return out.select(*by, "n1", "n2", "u", "p", "method")
