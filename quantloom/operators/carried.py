"""Values carried over any number of rows, without one task for each symbol.

Rows come in tiles (``tiles.tiled``). Each tile says what it hands on, in a table of one row per tile; that table is
carried forward tile by tile, and every tile is then finished from what reached its first row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..cluster import ship_package


def last_known(rows: DataFrame, values: dict[str, Column], key: str = "symbol") -> DataFrame:
    """``rows`` with the newest value of each of ``values`` at or before it that is not null, under the value's name.

    ``rows`` has ``n`` and ``tile``, and ``own`` where tiles bring a copy of the row before them, which is right too.
    """
    start = Window.unboundedPreceding
    rows = rows.withColumns({f"__{c}": v for c, v in values.items()})
    own = rows.where("tile = own") if "own" in rows.columns else rows
    ends = own.groupBy(key, "tile").agg(*(F.max_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), F.col("n"))).alias(f"__{c}") for c in values))
    earlier = Window.partitionBy(key).orderBy("tile").rowsBetween(start, -1)
    ends = ends.select(key, "tile", *(F.last(f"__{c}", ignorenulls=True).over(earlier).alias(f"__was_{c}") for c in values))
    inside = Window.partitionBy(key, "tile").orderBy("n").rowsBetween(start, 0)
    filled = rows.withColumns({f"__{c}": F.last(f"__{c}", ignorenulls=True).over(inside) for c in values}).join(ends, [key, "tile"])
    return filled.withColumns({c: F.coalesce(f"__{c}", f"__was_{c}") for c in values}).drop(*(f"{p}{c}" for c in values for p in ("__", "__was_")))


def carried_over(ends: DataFrame, step: Callable[[np.ndarray, np.ndarray | None], np.ndarray], key: str = "symbol") -> DataFrame:
    """(key, tile, carry): what reaches each tile, ``step(what the tile before hands on, what reached that one)``; null at the first.

    ``ends(key, tile, end)`` has an array for each tile, so a symbol is a row for each ten thousand of its rows here.
    """
    ship_package(ends.sparkSession)
    schema = StructType([ends.schema[key], ends.schema["tile"], StructField("carry", ArrayType(DoubleType()))])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tile")
        out, carry = [], None
        for end in rows["end"]:
            out.append(carry)
            carry = step(np.asarray(end, float), carry)
        return pd.DataFrame({key: rows[key], "tile": rows["tile"], "carry": [None if c is None else c.tolist() for c in out]})

    return ends.groupBy(key).applyInPandas(run, schema)


def finished(rows: DataFrame, carries: DataFrame, columns: tuple[str, ...], fill: Callable[[pd.DataFrame, np.ndarray | None], dict[str, np.ndarray]], key: str = "symbol") -> DataFrame:
    """``rows`` with double ``columns`` that ``fill(a tile's rows in order, what reached it)`` makes."""
    schema = StructType([*(f for f in rows.schema.fields if f.name not in columns), *(StructField(c, DoubleType()) for c in columns)])

    def run(tile: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("n", kind="stable")
        reached = carry["carry"].iloc[0] if len(carry) else None
        return tile.assign(**fill(tile, None if reached is None else np.asarray(reached, float)))[schema.fieldNames()]

    return rows.groupBy(key, "tile").cogroup(carries.groupBy(key, "tile")).applyInPandas(run, schema)


def mean_of_newest(rows: DataFrame, value: Column, n: int, into: str, key: str = "symbol") -> DataFrame:
    """``into``: the mean of the newest ``n`` values that are not null, over any distance; 0 before the first.

    A tile hands on its newest n values; what reaches a tile are the newest n of all tiles before it.
    """
    rows = rows.withColumn("__value", value.cast("double"))
    newest = F.slice(F.array_sort(F.collect_list(F.when(F.col("__value").isNotNull(), F.struct("n", "__value")))), -n, n)
    size = F.count("__value")
    ends = rows.groupBy(key, "tile").agg(F.when(size > n, newest).otherwise(F.array_sort(F.collect_list(F.when(F.col("__value").isNotNull(), F.struct("n", "__value"))))).alias("__end"))
    ends = ends.select(key, "tile", F.col("__end")["__value"].alias("end"))

    def step(end: np.ndarray, carry: np.ndarray | None) -> np.ndarray:
        return end[-n:] if carry is None or len(end) >= n else np.concatenate([carry, end])[-n:]

    def fill(tile: pd.DataFrame, carry: np.ndarray | None) -> dict[str, np.ndarray]:
        before = np.empty(0) if carry is None else carry
        own = tile["__value"].to_numpy(float)
        valid = ~np.isnan(own)
        values = np.concatenate([before, own[valid]])
        if not len(values):
            return {into: np.zeros(len(own))}
        padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1), values]), n)
        means = padded.sum(axis=1) / np.minimum(np.arange(1, len(values) + 1), n)
        seen = len(before) + np.cumsum(valid)
        return {into: np.where(seen > 0, means[np.maximum(seen, 1) - 1], 0.0)}

    return finished(rows, carried_over(ends, step, key), (into,), fill, key).drop("__value")


def exponential_mean(rows: DataFrame, value: str, decay: float, into: str, start: float | None = None, key: str = "symbol") -> DataFrame:
    """``into``: decay times the mean before plus (1 - decay) times the value, from ``start`` (default: the first value) on; see ``exponential_means``."""
    return exponential_means(rows, {into: F.col(value)}, decay, start, key)


def exponential_means(rows: DataFrame, values: dict[str, Column], decay: float, start: float | None = None, key: str = "symbol") -> DataFrame:
    """The exponential mean of each of ``values`` under its name, all in one pass.

    Each row maps the mean to a mean, and the maps of a tile compose to one: a factor and a term. ``rows`` come in
    tiles; null values leave the mean.
    """
    names = list(values)
    rows = rows.withColumns({f"__{c}": v.cast("double") for c, v in values.items()})
    tile = Window.partitionBy(key, "tile")
    sofar = tile.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.withColumns({f"__later_{c}": F.count(f"__{c}").over(tile) - F.count(f"__{c}").over(sofar) for c in names})

    def maps(c: str) -> list[Column]:
        first = F.min_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), F.col("n")))
        term = F.sum((1 - decay) * F.pow(F.lit(decay), F.col(f"__later_{c}")) * F.col(f"__{c}"))
        return [F.pow(F.lit(decay), F.count(f"__{c}")), F.coalesce(term, F.lit(0.0)), F.coalesce(first, F.lit(float("nan")))]

    ends = parts.groupBy(key, "tile").agg(F.array(*(m for c in names for m in maps(c))).alias("end"))

    def step(end: np.ndarray, carry: np.ndarray | None) -> np.ndarray:
        factor, term, first = end.reshape(-1, 3).T
        before = np.full(len(factor), np.nan if start is None else start) if carry is None else carry
        return factor * np.where(np.isnan(before), first, before) + term

    def fill(tile: pd.DataFrame, carry: np.ndarray | None) -> dict[str, np.ndarray]:
        out = {}
        for i, c in enumerate(names):
            mean = float("nan" if start is None else start) if carry is None else float(carry[i])
            means = []
            for x in tile[f"__{c}"].tolist():
                if x == x:
                    mean = x if mean != mean else decay * mean + (1 - decay) * x
                means.append(mean)
            out[c] = np.array(means, float)
        return out

    return finished(rows, carried_over(ends, step, key), tuple(names), fill, key).drop(*(f"__{c}" for c in names))


def tracked_level(rows: DataFrame, value: str, process: float, measurement: float, into: str, key: str = "symbol", tile_rows: int = 10_000) -> DataFrame:
    """``into``: the level that a filter with fixed process and measurement variances follows; the first value is taken as it is.

    A row's gain depends on its number alone and settles within a few rows, so the rows of a tile compose to one factor
    and one term, as those of an exponential mean do. ``rows`` come in tiles of ``tile_rows`` with numbers ``n``.
    """
    gains = [1.0]
    error = 1.0
    while len(gains) < 3 or abs(gains[-1] - gains[-2]) > 1e-17 and len(gains) < 100_000:
        wide = error + process
        gains.append(wide / (wide + measurement))
        error = (1 - gains[-1]) * wide
    known = np.array(gains)

    def gain_at(n: np.ndarray) -> np.ndarray:
        return known[np.minimum(n - 1, len(known) - 1)]

    ship_package(rows.sparkSession)
    rows = rows.withColumn("__value", F.col(value).cast("double"))
    schema = StructType([rows.schema[key], rows.schema["tile"], StructField("end", ArrayType(DoubleType()))])

    def composed(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("n")
        gain = gain_at(tile["n"].to_numpy(np.int64))
        left = np.cumprod((1 - gain)[::-1])[::-1]  # of the value before, after this row and all later ones
        after = np.append(left[1:], 1.0)
        return pd.DataFrame({key: [tile[key].iloc[0]], "tile": tile["tile"].iloc[0], "end": [[left[0], float((gain * after * tile["__value"].to_numpy(float)).sum())]]})

    ends = rows.select(key, "tile", "n", "__value").groupBy(key, "tile").applyInPandas(composed, schema)

    def fill(tile: pd.DataFrame, carry: np.ndarray | None) -> dict[str, np.ndarray]:
        level, out = (0.0 if carry is None else float(carry[0])), []
        for x, g in zip(tile["__value"].tolist(), gain_at(tile["n"].to_numpy(np.int64)).tolist()):
            level += g * (x - level)
            out.append(level)
        return {into: np.array(out, float)}

    carries = carried_over(ends, lambda end, carry: np.array([end[0] * (0.0 if carry is None else carry[0]) + end[1]]), key)
    return finished(rows, carries, (into,), fill, key).drop("__value")
