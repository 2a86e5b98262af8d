"""Reports over signals, predictions, trades and trials."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from ..functions.normal import cumulative
from .trades import spearman


def contributions(signals: DataFrame, outcome: str = "ret") -> DataFrame:
    """``contribution, correct`` of ``signals(name, value, weight, ret)``: what a signal's direction earned, and whether it was right.

    A value or outcome of 0 (up to 1e-10) is not right.
    """
    earned = F.col("weight") * F.abs("value") * F.signum(F.col("value") * F.col(outcome))
    right = (F.signum("value") == F.signum(outcome)) & (F.abs("value") > 1e-10) & (F.abs(outcome) > 1e-10)
    return signals.withColumns({"contribution": earned, "correct": F.coalesce(right, F.lit(False))})


def signal_summary(signals: DataFrame, n: int = 1000, dead_after: int = 100, outcome: str = "ret") -> DataFrame:
    """One row for each signal, best first by ``rank``: profit over all rows, the rest over its last n rows, and whether it is dead.

    Dead: at least ``dead_after`` rows, of whose last so many under 0.45 are right, and a loss over all.
    ``signals(name, at, value, weight, ret)``, ``at`` ordering a signal's rows.
    """
    w = Window.partitionBy("name").orderBy(F.desc("at"))
    d = contributions(signals, outcome)
    # a task gives at most its own last n rows of each signal to the window; read twice
    recent = materialize(d.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= n), "recent-signals")
    newest = F.col("__back") <= dead_after
    share = lambda which: F.avg(F.when(which, F.when(F.col("correct"), 1.0).otherwise(0.0)))
    whole = d.groupBy("name").agg(F.sum("contribution").alias("total"), F.count("*").alias("__all"))
    g = recent.groupBy("name").agg(
        F.count("*").alias("n"),
        share(F.lit(True)).alias("hit_rate"),
        F.avg(F.abs("value")).alias("magnitude"),
        F.avg("weight").alias("weight"),
        F.coalesce(F.avg(F.when(F.col("correct"), F.col("contribution"))), F.lit(0.0)).alias("when_right"),
        F.coalesce(F.avg(F.when(~F.col("correct"), F.col("contribution"))), F.lit(0.0)).alias("when_wrong"),
        share(newest).alias("__newest"),
    )
    ic = spearman(recent, "value", outcome, ("name",)).select("name", "ic")
    g = whole.join(g, "name").join(ic, "name", "left").select("name", "total", "n", "hit_rate", "magnitude", "weight", "when_right", "when_wrong", "ic", "__newest", "__all")
    dead = (F.col("__all") >= dead_after) & (F.col("__newest") < 0.45) & (F.col("total") < 0)
    g = g.withColumn("dead", dead).drop("__newest", "__all")
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "name")))  # as many rows as signals


def predictor_metrics(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Errors of ``pairs(prediction, actual)`` by group: n, mae, rmse, accuracy of direction, r2 in [-1, 1], rank correlation; 0 with fewer than five."""
    error = F.col("actual") - F.col("prediction")
    right = F.when(F.signum("prediction") == F.signum("actual"), 1.0).otherwise(0.0)
    count = F.count("*")
    total = F.var_pop("actual") * count
    r2 = 1 - F.sum(error * error) / F.greatest(total, F.lit(1e-10))
    g = pairs.groupBy(*by).agg(count.alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(right).alias("accuracy"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r2)).alias("r2"))
    g = g.join(spearman(pairs, "prediction", "actual", by, least=3).select(*by, "ic"), list(by), "left")
    return g.withColumns({c: F.when(F.col("n") < 5, 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0))) for c in ("mae", "rmse", "accuracy", "r2", "ic")})


def paired(predictions: DataFrame, outcomes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The k-th prediction of each key with its k-th outcome; what is left over on either side is pending and does not come back."""
    number = lambda d: d.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "seq")))
    p = number(predictions).select(*keys, "__k", F.col("seq").alias("predicted_at"), "prediction")
    o = number(outcomes).select(*keys, "__k", F.col("seq").alias("realised_at"), "actual")
    return p.join(o, [*keys, "__k"]).withColumnRenamed("__k", "k")


def rejections(decisions: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int = 100, critical: float = 0.8) -> DataFrame:
    """``rejection_rate, degraded`` over the last n decisions (``reason`` null: accepted); degraded needs 20 of them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    d = decisions.withColumn("rejection_rate", F.avg(F.when(F.col("reason").isNotNull(), 1.0).otherwise(0.0)).over(w))
    return d.withColumn("degraded", (F.count("*").over(w) >= 20) & (F.col("rejection_rate") > critical))


def break_even(costs: DataFrame) -> DataFrame:
    """One row from ``costs(bps, net)``: slope of the net profit per basis point, and where it crosses 0.

    The crossing is interpolated in the first pair that goes from gain to loss; one and a half times the highest cost
    if all gain, 0 otherwise.
    """
    w = Window.orderBy("bps")  # as many rows as scenarios
    d = costs.withColumns({"__next_bps": F.lead("bps").over(w), "__next": F.lead("net").over(w)})
    at = F.when((F.col("net") >= 0) & (F.col("__next") < 0), F.col("bps") + F.col("net") / (F.col("net") - F.col("__next")) * (F.col("__next_bps") - F.col("bps")))
    g = d.agg(F.regr_slope("net", "bps").alias("elasticity"), F.min_by(at, F.when(at.isNotNull(), F.col("bps"))).alias("__at"), F.min("net").alias("__least"), F.max("bps").alias("__most"))
    return g.select("elasticity", F.coalesce("__at", F.when(F.col("__least") > 0, F.col("__most") * 1.5).otherwise(0.0)).alias("break_even"))


def stationarity(values: DataFrame, by: tuple[str, ...], least: int = 20) -> DataFrame:
    """Whether the halves of each series agree: (by, n, variance_ratio, mean_z, stationary, verdict).

    ``values(k, x)``, k numbering a series from 1. Stationary: the second half's variance is between half and twice
    the first's, and the means are less than two deviations apart. Both tests of the joint verdict fall back on this
    rule. Shorter series than ``least`` are left out.
    """
    sized = values.join(values.groupBy(*by).agg(F.count("*").alias("__n")), list(by))
    first = F.col("k") <= F.floor(F.col("__n") / 2)
    part = lambda which: F.when(which, F.col("x"))
    g = sized.groupBy(*by).agg(
        F.count("*").alias("n"), F.var_pop(part(first)).alias("v1"), F.var_pop(part(~first)).alias("v2"), F.avg(part(first)).alias("m1"), F.avg(part(~first)).alias("m2"), F.stddev_pop("x").alias("s")
    ).where(F.col("n") >= least)
    g = g.withColumns({"variance_ratio": F.when(F.col("v1") > 0, F.col("v2") / F.col("v1")).otherwise(1.0), "mean_z": F.abs(F.col("m2") - F.col("m1")) / F.greatest("s", F.lit(1e-10))})
    g = g.withColumn("stationary", (F.col("variance_ratio") > 0.5) & (F.col("variance_ratio") < 2.0) & (F.col("mean_z") < 2.0))
    return g.select(*by, "n", "variance_ratio", "mean_z", "stationary", F.when(F.col("stationary"), "STATIONARY").otherwise("NON-STATIONARY").alias("verdict"))


def versus(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row: returns of both, excess, information ratio, share of steps with the strategy ahead, both drawdowns.

    ``strategy(i, pnl)`` and ``benchmark(i, pnl)`` are set side by side by number as far as the shorter goes.
    """
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as trades of one strategy

    def fall(d):
        run = d.withColumn("__c", F.sum("pnl").over(w))
        return run.withColumn("__fall", F.max("__c").over(w) - F.col("__c")).agg(F.sum("pnl").alias("total"), F.max("__fall").alias("fall"))

    a, b = fall(strategy), fall(benchmark)
    both = strategy.join(benchmark.withColumnRenamed("pnl", "other"), "i").withColumns({"__d": F.col("pnl") - F.col("other"), "__ahead": F.sum("pnl").over(w) > F.sum("other").over(w)})
    g = both.agg(F.when((F.count("*") > 1) & (F.stddev_pop("__d") > 1e-10), F.avg("__d") / F.stddev_pop("__d")).otherwise(0.0).alias("information_ratio"), F.avg(F.when(F.col("__ahead"), 1.0).otherwise(0.0)).alias("outperformed"))
    one = a.select(F.col("total").alias("strategy"), F.col("fall").alias("strategy_fall")).crossJoin(F.broadcast(b.select(F.col("total").alias("benchmark"), F.col("fall").alias("benchmark_fall")))).crossJoin(F.broadcast(g))
    return one.withColumn("excess", F.col("strategy") - F.col("benchmark"))


def verdict(sharpe: Column, degradation: Column, trades: Column, significant: Column, pbo: Column, least: int = 20) -> Column:
    """What an out-of-sample test says."""
    return (
        F.when((sharpe > 0) & (degradation < 1.5) & (trades >= least) & significant & (pbo <= 0.5), "CONFIRMED")
        .when(trades < least, "TOO_FEW_TRADES")
        .when(~significant, "NOT_SIGNIFICANT")
        .when(pbo > 0.5, "OVERFIT")
        .when((sharpe > 0) & (degradation >= 1.5), "POSSIBLY_OVERFIT")
        .otherwise("NO_ALPHA")
    )


def degradation(inside: Column, outside: Column) -> Column:
    """How much worse a ratio is outside than inside the sample; infinite if the one outside is about 0 and the other not."""
    none = F.abs(outside) < 0.01
    return F.when(F.abs(inside) > 0.01, F.when(~none & (F.abs(outside) > 0.01), F.abs(inside / outside)).otherwise(float("inf"))).otherwise(F.when(none, 1.0).otherwise(float("inf")))


def growing_folds(rows: DataFrame, folds: int = 3) -> DataFrame:
    """Folds of n // (folds + 1) rows: fold i trains on the first i + 1 of them and tests on the next: (fold, train_last, test_first, test_last)."""
    size = F.floor(F.col("n") / (folds + 1)).cast("long")
    return rows.select(F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), size.alias("size")).select(
        "fold", ((F.col("fold") + 1) * F.col("size")).alias("train_last"), ((F.col("fold") + 1) * F.col("size") + 1).alias("test_first"), ((F.col("fold") + 2) * F.col("size")).alias("test_last")
    )


def position_states(events: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``position, pending`` after each of ``events(kind, signed)``: SUBMITTED adds to what is pending, FILLED moves it to the position, CANCELLED and REJECTED take it away."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    moved = F.when(F.col("kind") == "FILLED", F.col("signed")).otherwise(0.0)
    waits = F.when(F.col("kind") == "SUBMITTED", F.col("signed")).otherwise(-F.col("signed"))
    return events.withColumns({"position": F.sum(moved).over(w), "pending": F.sum(waits).over(w)})


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_probability(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t, in Arrow batches; meant for a row per group."""

    @F.pandas_udf("double")
    def p(t: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or v < 1 else incomplete_beta(v / 2, 0.5, v / (v + x * x)) for x, v in zip(t, freedom)], dtype=float)

    return p(t, freedom.cast("double"))


def predictive_regimes(returns: DataFrame, by: tuple[str, ...] = ("symbol", "regime_id"), least: int = 30, level: float = 0.05, n: int = 2000) -> DataFrame:
    """t-test of each regime's last n forward returns against 0: (by, n, t, p, banned, reason). Banned: ``p`` is not below ``level``.

    ``returns(at, ret)``; with fewer than ``least`` nothing is banned and p is 1.
    """
    ship_package(returns.sparkSession)
    w = Window.partitionBy(*by).orderBy(F.desc("at"))
    d = returns.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= n)
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    t = F.when((F.col("n") >= least) & (F.col("s") > 0), F.col("m") / (F.col("s") / F.sqrt("n")))
    g = g.withColumn("t", t).withColumn("p", F.coalesce(t_probability(F.col("t"), F.col("n") - 1), F.lit(1.0)))
    few = F.col("n") < least
    banned = ~few & (F.col("p") >= level)
    return g.select(*by, "n", "t", "p", banned.alias("banned"), F.when(few, "TOO_FEW").when(banned, "NOT_PREDICTIVE").otherwise("PREDICTIVE").alias("reason"))


def search_points(spark, space: list[tuple[str, float, float, bool]], trials: int, seed: int = 42) -> DataFrame:
    """(trial, name, value): the defaults' neighbourhood drawn uniformly, on a log scale where told, one row for each trial and parameter.

    ``space``: (name, low, high, log). Draws are portable hashes, so a trial is the same wherever it is computed.
    """
    names = spark.createDataFrame([(i, *row) for i, row in enumerate(space)], "i int, name string, low double, high double, log boolean")
    d = names.crossJoin(F.broadcast(spark.range(trials).toDF("trial")))  # two tables of bounded size
    u = (F.pmod(F.xxhash64(F.lit(seed), "trial", "i"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    even = F.col("low") + (F.col("high") - F.col("low")) * u
    logged = F.exp(F.log("low") + (F.log("high") - F.log("low")) * u)
    return d.select("trial", "name", F.when(F.col("log"), logged).otherwise(even).alias("value"))


