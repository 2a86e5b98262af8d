"""Exact quantiles of groups of any size, with bounded buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize

GRID = 256
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...], held: int = 1_000_000, names: tuple[str, ...] | None = None) -> DataFrame:
    """(by, n, and a column per share): linear-interpolated quantiles of the values of each group that are not null.

    Where no group has more than ``held`` rows, its values are sorted in one buffer. Beyond that, the values at the two
    ranks that a quantile lies between are found by narrowing: a sketch, whose error is bounded, names two values around
    the rank; rows between them are counted exactly and go on, until ``held`` or fewer are left, or all are equal.
    """
    names = names or tuple(f"q{round(100 * s)}" for s in shares)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    sizes = materialize(rows.groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= held:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile("__v", F.lit(s)).alias(c) for s, c in zip(shares, names)))
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    wanted = F.array(*(F.struct(F.lit(c).alias("name"), rank.cast("long").alias("rank"), F.lit(side).alias("side")) for s, c in zip(shares, names) for side, rank in ((0, F.floor(place(s))), (1, F.ceil(place(s))))))
    targets = sizes.select(*by, F.explode(wanted).alias("t")).select(*by, "t.rank").distinct()
    found = values_at(rows, targets, by, held)
    out = sizes
    for s, c in zip(shares, names):
        for side, rank in (("low", F.floor(place(s))), ("high", F.ceil(place(s)))):
            at = found.select(*(F.col(k).alias(f"__{k}") for k in by), F.col("rank").alias("__rank"), F.col("at").alias(f"__{side}"))
            out = _joined(out, at, by, rank.cast("long") == F.col("__rank")).drop("__rank", *(f"__{k}" for k in by))
        out = out.withColumn(c, F.col("__low") + (F.col("__high") - F.col("__low")) * (place(s) - F.floor(place(s)))).drop("__low", "__high")
    return out


def _joined(left: DataFrame, right: DataFrame, by: tuple[str, ...], and_: Column) -> DataFrame:
    condition = and_
    for k in by:
        condition = condition & left[k].eqNullSafe(right[f"__{k}"])
    return left.join(right, condition)


def values_at(rows: DataFrame, targets: DataFrame, by: tuple[str, ...], held: int) -> DataFrame:
    """(by, rank, at): the value ``__v`` at each rank, from 0, of ``targets(by, rank)``."""
    spans = F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(2**62).cast("long").alias("inside")
    open_ = materialize(targets.select(*by, "rank", *spans), "targets")
    done = None
    while True:
        named = open_.select(*(F.col(k).alias(f"__{k}") for k in by), "rank", "lo", "hi", "below", "inside")
        near = _joined(rows, named, by, F.col("__v").between(F.col("lo"), F.col("hi"))).drop(*(f"__{k}" for k in by))
        few = open_.where((F.col("inside") <= held) | (F.col("lo") == F.col("hi")))
        if not few.isEmpty():
            small = near.where((F.col("inside") <= held) & (F.col("lo") < F.col("hi"))).groupBy(*by, "rank", "below").agg(F.sort_array(F.collect_list("__v")).alias("vs"))
            answers = small.select(*by, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("at"))
            answers = answers.unionByName(open_.where(F.col("lo") == F.col("hi")).select(*by, "rank", F.col("lo").alias("at")))
            done = answers if done is None else done.unionByName(answers)
        rest = open_.where((F.col("inside") > held) & (F.col("lo") < F.col("hi")))
        if rest.isEmpty():
            return materialize(done, "found") if done is not None else targets.select(*by, "rank", F.lit(None).cast("double").alias("at")).limit(0)
        near = near.where((F.col("inside") > held) & (F.col("lo") < F.col("hi")))
        grid = F.percentile_approx("__v", [i / GRID for i in range(GRID + 1)], ACCURACY)
        sketch = near.groupBy(*by, "rank", "below").agg(grid.alias("grid"), F.count("*").alias("size"))
        cell = (F.col("rank") - F.col("below")) * GRID / F.col("size")
        edge = lambda i: F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int"))
        cut = materialize(sketch.select(*by, "rank", F.col("below").alias("was"), edge(F.floor(cell) - 1).alias("lo"), edge(F.ceil(cell) + 1).alias("hi")), "cuts")
        named = cut.select(*(F.col(k).alias(f"__{k}") for k in by), F.col("rank").alias("__rank"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        counted = _joined(near.select(*by, "rank", "below", "__v"), named, by, F.col("rank") == F.col("__rank"))
        v = F.col("__v")
        narrowed = counted.groupBy(*by, "rank", "below").agg(
            F.count(F.when(v < F.col("__lo"), 1)).alias("less"), F.count(F.when(v <= F.col("__hi"), 1)).alias("upto"), F.first("__lo").alias("lo"), F.first("__hi").alias("hi")
        )
        # a value that repeats across the cuts is what is left of a group that cannot be narrowed further
        same = F.col("lo") == F.col("hi")
        open_ = materialize(narrowed.select(*by, "rank", "lo", "hi", (F.col("below") + F.col("less")).alias("below"), F.when(same, F.lit(0)).otherwise(F.col("upto") - F.col("less")).cast("long").alias("inside")), "targets")
