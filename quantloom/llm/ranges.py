"""Range buckets of a key: contiguous, of near equal counts, in ascending order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import default_parallelism


def boundaries(df: DataFrame, col: str, buckets: int) -> list[int]:
    """Ascending distinct boundaries of at most ``buckets`` ranges, from approximate quantiles of one column (no nulls)."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(F.col(col).cast("long"), shares, max(10_000, 4 * buckets)).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket_of(key: Column, edges: list[int]) -> Column:
    """How many of ``edges`` are at most ``key``, found by bisection in nested conditions; 0 for null."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(edges[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(key.isNull(), F.lit(0)).otherwise(search(0, len(edges))).cast("int")


def range_count(df: DataFrame, text_col: str, range_bytes: int) -> int:
    """Ranges of about ``range_bytes`` of text each, and no fewer than the session's usual shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")).alias("bytes")).first()["bytes"] or 0
    return max(default_parallelism(df.sparkSession), -(-total // range_bytes))
