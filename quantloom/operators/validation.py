"""Resampled intervals, validation and walk-forward reports as rows, search space, top features, exit journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize
from .performance import draw, sign_flips
from .quantiles import exact_quantiles

#: The parameters of the search, (group, name, low, high, default); whole numbers are integers.
SEARCH_SPACE = (
    ("regime", "min_cluster_size", 5, 50, 10),
    ("regime", "min_samples", 2, 15, 3),
    ("regime", "window_size", 50, 500, 200),
    ("regime", "update_frequency", 10, 100, 50),
    ("regime", "transition_strength_min", 0.05, 0.5, 0.2),
    ("regime", "kl_boost_threshold", 0.1, 1.0, 0.5),
    ("regime", "kl_boost_amount", 0.05, 0.5, 0.2),
    ("regime", "persistence_window", 5, 50, 20),
    ("decision", "long_skew_min", 0.001, 0.2, 0.01),
    ("decision", "long_tail_slope_min", 0.1, 2.0, 0.5),
    ("decision", "short_volatility_min", 1e-6, 0.001, 0.00001),
    ("decision", "short_skew_max", -0.5, -0.001, -0.01),
    ("decision", "short_kurtosis_min", 0.05, 2.0, 0.1),
    ("sizing", "base_size", 0.1, 5.0, 1.0),
    ("sizing", "max_size_multiplier", 1.0, 10.0, 3.0),
    ("risk", "max_drawdown", 0.01, 0.10, 0.02),
    ("risk", "confidence_floor", 0.0, 0.5, 0.0),
    ("risk", "regime_churn_limit", 2, 20, 5),
    ("calibration", "entropy_reduce_threshold", 1.0, 8.0, 4.0),
    ("calibration", "volatility_high_threshold", 0.001, 0.05, 0.01),
    ("calibration", "tail_slope_tighten", 1.0, 5.0, 2.0),
    ("calibration", "kurtosis_tighten", 1.0, 8.0, 3.0),
)
#: The parameters that are drawn on a log scale.
LOGGED = ("short_volatility_min", "volatility_high_threshold")


def applied_parameters(trials: DataFrame) -> DataFrame:
    """(trial, group, name, value) of every trial and parameter: that of ``trials(trial, name, value)`` within its bounds, else the default; integers are rounded."""
    spark = trials.sparkSession
    space = spark.createDataFrame([(g, n, float(low), float(high), float(d), isinstance(low, int)) for g, n, low, high, d in SEARCH_SPACE], "group string, name string, low double, high double, default double, whole boolean")
    every = trials.select("trial").distinct().crossJoin(F.broadcast(space))  # twenty-two rows
    value = F.greatest("low", F.least("high", F.coalesce("value", "default")))
    value = F.when(F.col("whole"), F.round(value)).otherwise(value)
    return every.join(trials.select("trial", "name", "value"), ["trial", "name"], "left").select("trial", "group", "name", value.alias("value"))


def resampled(values: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """(trial, total_return, mean, sharpe) of samples with replacement of ``values(i, x)``, numbered from 0; the ratio takes the population deviation, 0 without spread."""
    spark = values.sparkSession
    values = materialize(values, "values")
    count = values.agg(F.count("*").alias("n"))
    places = values.select("i").crossJoin(F.broadcast(spark.range(trials).toDF("trial"))).crossJoin(F.broadcast(count))  # trials and one row
    picks = places.select("trial", (draw(F.col("trial"), F.col("i"), seed) % F.col("n")).alias("i"))
    g = picks.join(values, "i").groupBy("trial").agg(F.sum("x").alias("total_return"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("__s"))
    return g.select("trial", "total_return", "mean", F.when(F.col("__s") > 1e-10, F.col("mean") / F.col("__s")).otherwise(0.0).alias("sharpe"))


STATISTICS = ("total_return", "mean", "sharpe")


def intervals(values: DataFrame, trials: int = 5000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(statistic, estimate, low, high, significant) of the sum, the mean and the ratio of mean to deviation; significant: 0 lies outside."""
    long = resampled(values, trials, seed).select(F.inline(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in STATISTICS))))
    alpha = 1 - confidence
    bounds = exact_quantiles(long, "value", (alpha / 2, 1 - alpha / 2), ("statistic",), names=("low", "high")).drop("n")
    s = F.stddev_pop("x")
    seen = values.agg(F.sum("x").alias("total_return"), F.avg("x").alias("mean"), F.when(s > 1e-10, F.avg("x") / s).otherwise(0.0).alias("sharpe"))
    seen = seen.select(F.inline(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("estimate")) for c in STATISTICS))))
    return seen.join(bounds, "statistic").select("statistic", "estimate", "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def validation_report(values: DataFrame, trials: int = 5000, level: float = 0.05, multiples: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """(section, metric, value): returns, the interval of their sum, the sign-flip test, totals at multiples of cost, and whether all is significant.

    ``values(i, x)``. A multiple m of cost takes (m - 1) times the mean loss, times the share of losses, off every
    value. Fewer than five values are not significant.
    """
    s, losing = F.stddev_pop("x"), F.when(F.col("x") < 0, -F.col("x"))
    one = values.agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.when(s > 1e-10, F.avg("x") / s).otherwise(0.0).alias("sharpe"), F.abs(F.avg("x")).alias("seen"), F.coalesce(F.sum(losing), F.lit(0.0)).alias("lost"))
    ci = intervals(values, trials).where("statistic = 'total_return'").select("low", "high", F.col("significant").alias("apart"))
    p = sign_flips(values, trials).crossJoin(F.broadcast(one.select("seen"))).agg(F.avg(F.when(F.abs("mean") >= F.col("seen"), 1.0).otherwise(0.0)).alias("p"))  # one row
    row = one.crossJoin(F.broadcast(ci)).crossJoin(F.broadcast(p))  # one row each
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    significant = (F.col("n") >= 5) & F.col("apart") & (F.col("p") < level)
    metrics = [("summary", "trades", F.col("n")), ("summary", "total_return", F.col("total")), ("summary", "sharpe", F.col("sharpe")), ("bootstrap", "low", F.col("low")), ("bootstrap", "high", F.col("high")), ("bootstrap", "significant", flag(F.col("apart"))), ("permutation", "p_value", F.col("p")), ("permutation", "significant", flag(F.col("p") < level))]
    # the mean loss times the share of losses is the sum of losses over all values
    metrics += [("cost", f"{m:g}x", F.col("total") - F.col("lost") * (m - 1)) for m in multiples]
    metrics.append(("verdict", "significant", flag(significant)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("section"), F.lit(b).alias("metric"), c.cast("double").alias("value")) for a, b, c in metrics))))


def walk_forward_report(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str = "pnl", folds: int = 5, min_train: float = 0.5, least: int = 100) -> DataFrame:
    """(by, fold, train_n, test_n, train_sharpe, test_sharpe, overfit): expanding folds of each series of at least ``least`` rows.

    Fold i trains on the first min_train + i (1 - min_train) / folds of the rows and tests on the next share, the last
    fold on all that are left. ``overfit`` is the ratio of both Sharpe ratios in size; where the one outside is about 0,
    it is infinite, or 1 if the one inside is small too. Prefix sums by fold: each row is counted once.
    """
    if folds < 2 or not 0.2 <= min_train < 1:
        raise ValueError("at least two folds, and a training share of 0.2 to 1")
    w = Window.partitionBy(*by).orderBy(*order)
    d = rows.select(*by, *order, value).withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    d = d.where(F.col("__n") >= least)
    step = (1 - min_train) / folds
    edge = lambda i: F.col("__n") if i == folds else F.floor(F.col("__n") * F.lit(min_train + i * step) + 1e-9)
    part = F.lit(0)
    for i in range(folds):
        part = part + F.when(F.col("__k") > edge(i), 1).otherwise(0)
    x = F.col(value)
    sums = d.withColumn("__part", part).groupBy(*by, "__part").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({f"t{c}": F.sum(c).over(before) for c in ("n", "s", "q")}).where("__part > 0")

    def sharpe(n: Column, s: Column, q: Column) -> Column:
        deviation = F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
        return F.when((n > 1) & (deviation > 1e-12), s / n / deviation).otherwise(0.0)

    train, test = sharpe(F.col("tn"), F.col("ts"), F.col("tq")), sharpe(F.col("n"), F.col("s"), F.col("q"))
    out = sums.select(*by, (F.col("__part") - 1).alias("fold"), F.col("tn").alias("train_n"), F.col("n").alias("test_n"), train.alias("train_sharpe"), test.alias("test_sharpe"))
    a, b = F.abs("train_sharpe"), F.abs("test_sharpe")
    return out.withColumn("overfit", F.when(b > 0.01, a / b).when(a > 0.1, float("inf")).otherwise(1.0))


def overfit_share(report: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, mean_test_sharpe, mean_overfit, pbo): of at least four folds, the share whose ratio exceeds 2 or that lose outside; 0 for fewer. Infinite ratios are left out of the mean."""
    bad = (F.col("overfit") > 2) | (F.col("test_sharpe") < 0)
    finite = F.when(F.col("overfit") < float("inf"), F.col("overfit"))
    return report.groupBy(*by).agg(
        F.avg("test_sharpe").alias("mean_test_sharpe"), F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean_overfit"), F.when(F.count("*") >= 4, F.avg(F.when(bad, 1.0).otherwise(0.0))).otherwise(0.0).alias("pbo")
    )


def top_features(rows: DataFrame, cols: tuple[str, ...], target: str, by: tuple[str, ...], k: int = 5) -> DataFrame:
    """(by, rank, feature, weight): the k features that weigh most on ``target`` by size, each weight being its correlation, 0 without spread; ties by name."""
    known = rows.where(F.col(target).isNotNull())
    y = lambda c: F.stddev_pop(F.when(F.col(c).isNotNull(), F.col(target)))
    g = known.groupBy(*by).agg(*(F.try_divide(F.covar_pop(c, target), F.stddev_pop(c) * y(c)).alias(c) for c in cols))
    long = g.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias("weight")) for c in cols))))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("weight")), "feature"))
    return long.withColumn("rank", rank).where(F.col("rank") <= k)
