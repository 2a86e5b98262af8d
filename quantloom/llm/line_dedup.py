"""Line deduplication by site-relative frequency: lines surely on more than a small share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(docs: DataFrame, ratio: float, z: float, min_on: int, host_col: str, text_col: str) -> DataFrame:
    """One row per host with boilerplate: (host, lines), the hashes of lines that are surely on more than ``ratio`` of its pages.

    Sure means that the lower ``z`` bound (Wilson's) of on/pages exceeds the ratio, which is the same as
    on > ratio * pages + z * sqrt(ratio * (1 - ratio) * pages); ``z`` = 0 takes the bare share.

    Pages of a host with the same text are one page, so that a copied page's own lines do not become boilerplate.
    A host has fewer than (lines per page) / ratio such lines, so ``lines`` stays small.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    pages = pages.select("host", F.xxhash64("text").alias("page"), F.array_distinct(F.transform(F.split("text", "\n"), _line_hash)).alias("lines"))
    totals = pages.groupBy("host", "page").count().groupBy("host").agg(F.count("*").alias("pages"))
    shared = pages.select("host", "page", F.explode("lines").alias("line")).where(F.col("line") != _line_hash(F.lit("")))
    shared = shared.groupBy("host", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("on"))
    shared = shared.where(F.col("on") >= min_on)
    found = shared.join(totals, shared["host"].eqNullSafe(totals["host"])).where(F.col("on") > ratio * F.col("pages") + z * F.sqrt(ratio * (1 - ratio) * F.col("pages")))
    return found.groupBy(shared["host"].alias("host")).agg(F.sort_array(F.collect_set("line")).alias("lines"))


def drop_boilerplate_lines(
    docs: DataFrame,
    ratio: float = 0.01,
    host_col: str = "source",
    text_col: str = "text",
    z: float = 2.326,
    min_on: int = 3,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; adds ``dropped_lines`` (long).

    A line (compared without outer blanks) is boilerplate if it is on ``min_on`` distinct pages of its host or more
    and the lower ``z`` bound of its share of them exceeds ``ratio``, by the same rule at every size of host; blank
    lines are never any. Every row comes back, its other columns as they were: a null text stays null with 0 dropped lines, a text of nothing but
    boilerplate becomes empty, a null host is a host of its own. A column named ``dropped_lines`` is replaced.
    """
    found = materialize(boilerplate_lines(docs, ratio, z, min_on, host_col, text_col), "boilerplate").select(
        F.col("host").alias("__host"), F.col("lines").alias("__lines")
    )
    kept_columns = [c for c in docs.columns if c != "dropped_lines"]
    joined = docs.select(*kept_columns).join(found, docs[host_col].eqNullSafe(found["__host"]), "left")
    split = F.split(F.col(text_col), "\n")
    rest = F.filter(F.col("__split"), lambda line: ~F.array_contains(F.col("__lines"), _line_hash(line)))
    joined = joined.withColumn("__split", F.when(F.col("__lines").isNotNull(), split)).withColumn("__rest", rest)
    dropped = F.coalesce(F.size("__split") - F.size("__rest"), F.lit(0))
    dropped = F.when(F.col("__split").isNull(), F.lit(0)).otherwise(dropped).cast("long")
    text = F.when(dropped > 0, F.array_join("__rest", "\n")).otherwise(F.col(text_col))
    return joined.withColumn("dropped_lines", dropped).withColumn("__text", text).select(
        *(F.col("__text").alias(c) if c == text_col else F.col(c) for c in kept_columns), "dropped_lines"
    )
