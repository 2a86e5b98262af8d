"""Regime, risk and model monitoring as windows and small aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import SYMBOL, last, ordered, sliding_moments, sliding_sums, so_far


def running_scale(df: DataFrame, cols, keys=SYMBOL) -> DataFrame:
    """Each column scaled by the mean and population deviation of all rows so far (a deviation of 0 counts as 1), as ``col_z``."""
    w = so_far(keys)
    scale = {c: F.when(F.stddev_pop(c).over(w) > 0, F.stddev_pop(c).over(w)).otherwise(1.0) for c in cols}
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / scale[c] for c in cols})


def regime_label(mu: Column, sigma: Column, entropy: Column) -> Column:
    """Words for a regime's centroid."""
    words = F.array_compact(
        F.array(
            F.when(sigma > 1e-3, "HighVol").when(sigma < 1e-4, "LowVol"),
            F.when(entropy > -4, "HighEntropy"),
            F.when(mu > 1e-4, "Bullish").when(mu < -1e-4, "Bearish"),
        )
    )
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise("Neutral")


def risk_regime(df: DataFrame, keys=SYMBOL) -> DataFrame:
    """``vol_ratio, risk_regime`` and ``size_multiplier``: the deviation of the last 20 returns over the mean of its last 100 values."""
    df = sliding_moments(df, "ret", 20, keys)
    df = df.withColumn("vol", F.when(F.col("__n") >= 10, F.sqrt("__m2"))).drop("__n", "__mean", "__m2")
    df = sliding_sums(df, {"__s": F.col("vol"), "__c": F.when(F.col("vol").isNotNull(), 1.0)}, 100, keys)
    mean = F.when(F.col("__c") > 0, F.col("__s") / F.col("__c"))
    df = df.withColumn("vol_ratio", F.when(mean > 0, F.col("vol") / mean))
    df = df.withColumn("risk_regime", F.when(F.col("vol_ratio") > 2.0, "CRISIS").when(F.col("vol_ratio") > 1.5, "HIGH").when(F.col("vol_ratio") > 1.1, "ELEVATED").otherwise("NORMAL"))
    multiplier = F.when(F.col("risk_regime") == "CRISIS", 0.25).when(F.col("risk_regime") == "HIGH", 0.5).when(F.col("risk_regime") == "ELEVATED", 0.75).otherwise(1.0)
    return df.withColumn("size_multiplier", multiplier).drop("__s", "__c")


def drift(df: DataFrame, cols, regime: str = "regime_id", keys=SYMBOL) -> DataFrame:
    """``drift``: mean over the last 100 rows of a regime of the scaled distance to its first state; ``broken`` above 2."""
    own = (*keys, regime)
    w = so_far(own)
    parts = []
    for c in cols:
        spread = F.when(F.count(c).over(w) >= 20, F.sqrt(F.var_pop(c).over(w)))
        parts.append(((F.col(c) - F.first(c).over(w)) / F.greatest(F.coalesce(spread, F.lit(1.0)), F.lit(1e-8))) ** 2)
    df = df.withColumn("__d", F.sqrt(sum(parts, F.lit(0.0))))
    return df.withColumn("drift", F.avg("__d").over(last(100, own))).withColumn("broken", F.col("drift") > 2).drop("__d")


def rolling_sharpe(df: DataFrame, n: int = 50, keys=SYMBOL) -> DataFrame:
    """``sharpe``: mean over population deviation of the n returns before; null until there are as many."""
    df = sliding_moments(df, "ret", n, keys, newest=1)
    deviation = F.sqrt("__m2")
    return df.withColumn("sharpe", F.when((F.col("__n") == n) & (deviation > 1e-15), F.col("__mean") / deviation)).drop("__n", "__mean", "__m2")


def long_trend(df: DataFrame, n: int = 750, keys=SYMBOL) -> DataFrame:
    """``rising``: whether the mean of the last n returns is positive, beyond rounding."""
    df = sliding_sums(df, {"__s": F.col("ret"), "__c": F.when(F.col("ret").isNotNull(), 1.0)}, n, keys)
    return df.withColumn("rising", F.coalesce(F.try_divide("__s", "__c") > 1e-12, F.lit(False))).drop("__s", "__c")


def regime_t(trades: DataFrame, least: int = 10) -> DataFrame:
    """(regime_id, n, t): t statistic of mean profit against 0; null with fewer than ``least`` trades."""
    t = F.avg("pnl") / (F.stddev_samp("pnl") / F.sqrt(F.count("*")))
    return trades.groupBy("regime_id").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, t).alias("t"))


def impact_coefficient(fills: DataFrame, least: int = 200) -> DataFrame:
    """(n, coefficient, calibrated): least squares through the origin of impact on volatility times the root of participation.

    ``fills(impact, volatility, participation)``; ratios outside (0, 10) do not count, the result lies in [0.01, 5].
    """
    x = F.greatest("volatility", F.lit(1e-8)) * F.sqrt(F.greatest("participation", F.lit(1e-10)))
    d = fills.select(F.abs("impact").alias("y"), x.alias("x"))
    d = d.withColumn("ok", (F.col("y") / F.col("x") > 0) & (F.col("y") / F.col("x") < 10))
    xy, xx = F.sum(F.when(F.col("ok"), F.col("x") * F.col("y"))), F.sum(F.when(F.col("ok"), F.col("x") * F.col("x")))
    enough = (F.count("*") >= least) & (F.sum(F.when(F.col("ok"), 1).otherwise(0)) >= 50)
    return d.agg(F.count("*").alias("n"), F.when(enough, F.greatest(F.lit(0.01), F.least(F.lit(5.0), xy / xx))).alias("coefficient"), enough.alias("calibrated"))


def rejected(orders: DataFrame) -> Column:
    """First entry gate that a proposal fails: noise, banned, unhealthy, toxic, information coefficient, cost, noise ratio; null if none."""
    return (
        F.when(F.col("regime_id") == -1, "NOISE")
        .when(F.col("banned"), "BANNED")
        .when(~F.col("healthy"), "UNHEALTHY")
        .when((F.col("n") >= 10) & ((F.col("win_rate") < 0.30) | (F.col("pnl") < -50)), "TOXIC")
        .when(F.col("ic") < 0.02, "LOW_IC")
        .when(F.abs("move") < 2 * F.col("cost"), "COST")
        .when(F.abs("move") / F.col("noise") < 0.5, "SNR")
    )


def rule_model(df: DataFrame) -> DataFrame:
    """``prediction, confidence`` from ofi, mom_50, mom_200 and mean_rev: momentum that has the sign of the order flow, and
    reversion beyond 1.5 deviations; momentum weighs 0.7 where the long momentum is above 0.005, else 0.3."""
    flow = F.when(F.abs("ofi") > 0.01, F.signum("ofi")).otherwise(0.0)
    momentum = F.when((F.abs("mom_50") > 1e-6) & (flow == F.signum("mom_50")), F.col("mom_50") * 0.3).otherwise(0.0)
    reversion = F.when(F.abs("mean_rev") > 1.5, -F.col("mean_rev") * 0.002).otherwise(0.0)
    df = df.withColumns({"__m": momentum, "__v": reversion})
    m, v = F.col("__m"), F.col("__v")
    prediction = F.when(F.abs("mom_200") > 0.005, m * 0.7 + v * 0.3).otherwise(m * 0.3 + v * 0.7)
    return df.withColumns({"prediction": prediction, "confidence": F.least(F.lit(1.0), (F.abs(m) + F.abs(v)) * 100)}).drop("__m", "__v")


def buy_and_hold(marks: DataFrame, keys=SYMBOL) -> DataFrame:
    """(first, last, ret, max_drawdown) of holding each symbol throughout."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    d = marks.withColumn("fall", F.col("price") / F.max("price").over(w) - 1)
    at = F.struct("ts", "seq")
    return d.groupBy(*keys).agg(F.min_by("price", at).alias("first"), F.max_by("price", at).alias("last"), F.min("fall").alias("max_drawdown")).withColumn("ret", F.col("last") / F.col("first") - 1)


def ruin(paths: DataFrame, floor: float) -> DataFrame:
    """Summary of simulated paths ``paths(trial, i, equity)``: survival share above ``floor`` and percentiles of the end."""
    ends = paths.groupBy("trial").agg(F.max_by("equity", "i").alias("end"), F.min("equity").alias("low"))
    return ends.agg(
        F.count("*").alias("trials"), F.avg(F.when(F.col("low") > floor, 1.0).otherwise(0.0)).alias("survival"), F.avg("end").alias("mean"),
        F.percentile("end", F.lit(0.05)).alias("p5"), F.percentile("end", F.lit(0.5)).alias("median"), F.percentile("end", F.lit(0.95)).alias("p95"),
    )


def sensitivity(base: Column, shifted: Column) -> Column:
    """Class of a parameter from the relative change of its objective: robust, sensitive or unstable."""
    change = F.abs(shifted - base) / F.greatest(F.abs(base), F.lit(1e-10))
    return F.when(change < 0.1, "robust").when(change < 0.5, "sensitive").otherwise("unstable")


def objective(sharpe: Column, fall: Column, churn: Column, impact: Column, most_fall: float = 0.2) -> Column:
    """Value to be minimised: minus the ratio, less ten times the excess drawdown, churn and impact."""
    return -(sharpe - 10 * F.greatest(F.lit(0.0), F.abs(fall) - most_fall) - churn - impact)


HALF_LIFE = 20.0


def remaining_edge(age: Column, half_life: float = HALF_LIFE) -> Column:
    """Share of an edge left after ``age`` windows."""
    return F.exp(-math.log(2) / half_life * age)
