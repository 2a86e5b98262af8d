"""Trade performance, risk measures and statistical validation as aggregations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism, materialize, ship_package
from ..functions import normal
from .quantiles import exact_quantiles

EULER_GAMMA = 0.5772156649
TRADE_ORDER = ("ts", "order_id", "line", "pnl")


def equity_curve(trades: DataFrame, start: float, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``equity, peak, dd`` of each account's trades in order; ``dd`` is 0 or negative."""
    w = Window.partitionBy(*by).orderBy(*TRADE_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("equity", F.lit(start) + F.sum("pnl").over(w))
    out = out.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(w)))
    return out.withColumn("dd", (F.col("equity") - F.col("peak")) / F.col("peak"))


def performance(trades: DataFrame, start: float, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row of metrics for each account.

    Ratios of daily profit use the sample deviation and the root of 252; the profit factor and omega are infinite
    without losses; drawdown is a negative share of the running peak.
    """
    daily = trades.groupBy(*by, F.to_date("ts").alias("day")).agg((F.sum("pnl") / max(start, 1.0)).alias("ret"))
    sharpe = daily.groupBy(*by).agg(
        F.when((F.count("*") >= 2) & (F.stddev_samp("ret") > 1e-15), F.avg("ret") / F.stddev_samp("ret") * math.sqrt(252)).otherwise(0.0).alias("sharpe")
    )
    won, lost = F.col("pnl") > 0, F.col("pnl") < 0
    gains, losses = F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)), F.coalesce(-F.sum(F.when(lost, F.col("pnl"))), F.lit(0.0))
    downside = F.coalesce(F.stddev_samp(F.when(lost, F.col("pnl"))), F.stddev_samp("pnl"))
    curve = equity_curve(trades, start, by)
    base = curve.groupBy(*by).agg(
        F.count("*").alias("trades"),
        F.sum("pnl").alias("total_pnl"),
        F.avg(F.when(won, 1.0).otherwise(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(won, F.col("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(lost, F.col("pnl"))), F.lit(0.0)).alias("avg_loss"),
        F.when(losses > 0, gains / losses).otherwise(float("inf")).alias("profit_factor"),
        F.min("dd").alias("max_drawdown"),
        F.when(downside > 1e-10, F.avg("pnl") / downside).otherwise(0.0).alias("sortino"),
        F.avg("pnl").alias("expectancy"),
        F.avg("qty").alias("avg_size"),
        F.avg("mae_pct").alias("avg_mae"),
        F.avg("mfe_pct").alias("avg_mfe"),
        F.skewness("pnl").alias("skew"),
        F.kurtosis("pnl").alias("kurt"),
        F.min("pnl").alias("worst"),
        F.avg(F.when(F.col("regime_id") == -1, 0.0).otherwise(1.0)).alias("regime_accuracy"),
        (F.sum("pnl") / F.when(F.sum(F.abs("entry_entropy")) > 0, F.sum(F.abs("entry_entropy"))).otherwise(1.0)).alias("entropy_adjusted"),
    )
    base = base.join(sharpe, list(by))
    return base.withColumns(
        {
            "calmar": F.when(F.abs("max_drawdown") > 1e-10, F.col("total_pnl") / start / F.abs("max_drawdown")).otherwise(0.0),
            "edge_capture": F.when(F.col("avg_mfe") > 1e-10, F.col("expectancy") / F.col("avg_mfe")).otherwise(0.0),
        }
    )


def rolling_trades(trades: DataFrame, sizes=(20, 50, 100), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Win rate, profit factor and expectancy of the last 20, 50 and 100 trades, and whether the shortest is degraded.

    A loss is a profit of 0 or less here, and the profit factor divides by 1e-10 at least.
    """
    out = {}
    for n in sizes:
        w = Window.partitionBy(*by).orderBy(*TRADE_ORDER).rowsBetween(1 - n, 0)
        won = F.col("pnl") > 0
        gains, losses = F.sum(F.when(won, F.col("pnl")).otherwise(0.0)).over(w), -F.sum(F.when(~won, F.col("pnl")).otherwise(0.0)).over(w)
        out |= {f"wr_{n}": F.avg(F.when(won, 1.0).otherwise(0.0)).over(w), f"pf_{n}": gains / F.greatest(losses, F.lit(1e-10)), f"exp_{n}": F.avg("pnl").over(w)}
    done = trades.withColumns(out)
    return done.withColumn("degraded", (F.col(f"wr_{sizes[0]}") < 0.4) & (F.col(f"exp_{sizes[0]}") < 0))


def value_at_risk(returns: DataFrame, by: tuple[str, ...], confidence: float = 0.95, least: int = 20) -> DataFrame:
    """(n, var, cvar) by group: lower percentile (linear) and the mean of returns not above it; null with too few."""
    level = exact_quantiles(returns, "ret", (1 - confidence,), by, names=("var",))
    level = level.withColumn("var", F.when(F.col("n") >= least, F.col("var")))
    if by:
        tail = returns.join(level, list(by)).where("ret <= var").groupBy(*by).agg(F.avg("ret").alias("cvar"))
        return level.join(tail, list(by), "left")
    tail = returns.crossJoin(F.broadcast(level)).where("ret <= var").agg(F.avg("ret").alias("cvar"))  # one row
    return level.crossJoin(F.broadcast(tail))  # one row


def regime_var(returns: DataFrame, confidence: float = 0.95, least: int = 20) -> DataFrame:
    """Value at risk of each regime, the unconditional one where a regime has too few returns."""
    whole = value_at_risk(returns, (), confidence, least).select(F.col("var").alias("all_var"), F.col("cvar").alias("all_cvar"))
    by = value_at_risk(returns, ("regime_id",), confidence, least).crossJoin(F.broadcast(whole))  # one row
    return by.select("regime_id", "n", F.coalesce("var", "all_var").alias("var"), F.coalesce("cvar", "all_cvar").alias("cvar"), F.col("var").isNotNull().alias("own"))


def deflated_sharpe(df: DataFrame, sharpe: str, trials: str, n: str, skew: str, kurt: str, trial_deviation: float = 1.0) -> DataFrame:
    """``expected_max, dsr, p_value`` of an observed ratio that is the best of several trials; ``kurt`` is excess kurtosis.

    The variance term uses a quarter of the excess kurtosis as it is.
    """
    t = F.greatest(F.col(trials), F.lit(1)).cast("double")
    top = trial_deviation * ((1 - EULER_GAMMA) * normal.quantile(1 - 1 / t) + EULER_GAMMA * normal.quantile(1 - 1 / (t * math.e)))
    s = F.col(sharpe)
    spread = F.greatest(F.lit(0.0), 1 - F.col(skew) * s + F.col(kurt) / 4 * s * s) / F.greatest(F.greatest(F.col(n), F.lit(2)) - 1, F.lit(1))
    df = df.withColumn("expected_max", F.when(t > 1, top).otherwise(0.0))
    df = df.withColumn("dsr", (s - F.col("expected_max")) / F.greatest(F.sqrt(spread), F.lit(1e-10)))
    return df.withColumn("p_value", 1 - normal.cumulative(F.col("dsr")))


def probabilistic_sharpe(sharpe: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true ratio exceeds a benchmark."""
    error = F.sqrt((1 - skew * sharpe + kurt / 4 * sharpe * sharpe) / F.greatest(n - 1, F.lit(1)))
    sure = F.when(sharpe > benchmark, 1.0).otherwise(0.0)
    return F.when(n < 2, 0.5).when(error < 1e-10, sure).otherwise(normal.cumulative((sharpe - benchmark) / error))


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``significant`` where the p-value is below alpha over the number of tests."""
    count = tests.agg(F.count("*").alias("tests"))
    return tests.crossJoin(F.broadcast(count)).withColumn("significant", F.col("p_value") < alpha / F.col("tests"))  # one row


def false_discovery(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: ``rejected`` for the p-values up to the largest with p <= alpha * rank / count.

    Ranks count the p-values not above. Distinct values are put into ranges of their logarithm, of which there are fewer
    than 200,000; one window adds up the ranges, others rank the values within each.
    """
    steps = tests.groupBy("p_value").agg(F.count("*").alias("same"))
    place = F.when(F.col("p_value") <= 0, F.lit(-(1 << 20))).otherwise(F.ceil(F.log("p_value") * 256)).cast("int")
    steps = steps.withColumn("__range", place)
    before = F.sum("here").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = steps.groupBy("__range").agg(F.sum("same").alias("here")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("same").over(Window.partitionBy("__range").orderBy("p_value").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("__inside", inside).join(ranges, "__range").withColumn("rank", F.col("__before") + F.col("__inside"))
    count = tests.agg(F.count("*").alias("tests"))
    cut = steps.crossJoin(F.broadcast(count)).where(F.col("p_value") <= alpha * F.col("rank") / F.col("tests")).agg(F.max("p_value").alias("cut"))
    return tests.crossJoin(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col("p_value") <= F.col("cut"), F.lit(False))).drop("cut")


def gini(df: DataFrame, col: str, by: tuple[str, ...]) -> DataFrame:
    """Gini coefficient of absolute values by group; 0 where all are 0."""
    w = Window.partitionBy(*by).orderBy(F.abs(col))
    ranked = df.withColumn("__i", F.row_number().over(w)).withColumn("__x", F.abs(col))
    n, total = F.count("*"), F.sum("__x")
    return ranked.groupBy(*by).agg(F.when(total > 0, (2 * F.sum(F.col("__i") * F.col("__x")) - (n + 1) * total) / (n * total)).otherwise(0.0).alias("gini"))


def combinatorial_overfit(returns: DataFrame, blocks: int = 8, most_trials: int = 20_000) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric splits: (splits, pbo, mean_logit).

    ``returns(trial, block, ret)``. Sums of each (trial, block) are taken once; a split in and out of sample adds up
    blocks, so no split reads the returns again. A split overfits if its best trial in sample is below the median out of sample.
    Up to ``most_trials`` trials the block sums go to every task as one row, and splits are a 0/1 matrix times them.
    """
    spark = returns.sparkSession
    ship_package(spark)
    sums = returns.groupBy("trial", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") ** 2).alias("q"))
    sums = materialize(sums, "block-sums")
    trials = sums.select("trial").distinct().count()
    ranked = split_ranks(sums, blocks) if trials <= most_trials and blocks % 2 == 0 else joined_split_ranks(sums, blocks)
    share = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("rank") / max(trials - 1, 1)))
    logit = F.log(share / (1 - share))
    return ranked.agg(F.count("*").alias("splits"), F.avg(F.when(logit < 0, 1.0).otherwise(0.0)).alias("pbo"), F.avg(logit).alias("mean_logit"))


def sharpe_of_sums(n, s, q):
    """Mean over sample deviation from counts, sums and sums of squares; 0 without spread."""
    mean = s / np.maximum(n, 1)
    deviation = np.sqrt(np.maximum((q - n * mean * mean) / np.maximum(n - 1, 1), 0.0))
    return np.where(deviation > 1e-15, mean / np.where(deviation > 0, deviation, 1.0), 0.0)


def split_ranks(sums: DataFrame, blocks: int) -> DataFrame:
    """(split, rank): the place out of sample, from 0, of each split's best trial; a split and its complement share their sums."""
    spark = sums.sparkSession
    half = math.comb(blocks, blocks // 2) // 2  # those that hold the first block, if blocks are even in number
    row = sums.agg(F.collect_list(F.struct("trial", "block", "n", "s", "q")).alias("sums"))
    tasks = min(default_parallelism(spark), half)
    work = spark.range(0, half, 1, tasks).crossJoin(F.broadcast(row))  # one row of bounded size

    def run(batches):
        from itertools import combinations

        chosen = np.zeros((2 * half, blocks))
        for i, inside in enumerate(combinations(range(blocks), blocks // 2)):
            chosen[i, list(inside)] = 1.0
        held = None
        for batch in batches:
            if held is None:
                found = batch["sums"].iloc[0]
                names = sorted({r["trial"] for r in found})
                place = {t: i for i, t in enumerate(names)}
                held = np.zeros((3, blocks, len(names)))
                for r in found:
                    held[:, r["block"], place[r["trial"]]] = r["n"], r["s"], r["q"]
            numbers = batch["id"].to_numpy()
            out = []
            for low in range(0, len(numbers), 256):
                part = numbers[low : low + 256]
                inside, outside = (sharpe_of_sums(*(m @ held[k] for k in range(3))) for m in (chosen[part], 1 - chosen[part]))
                for first, second, number in ((inside, outside, part), (outside, inside, 2 * half - 1 - part)):
                    best = first.argmax(axis=1)
                    own = second[np.arange(len(part)), best][:, None]
                    earlier = np.arange(second.shape[1])[None, :] < best[:, None]
                    out.append(pd.DataFrame({"split": number, "rank": ((second < own) | (second == own) & earlier).sum(axis=1)}))
            yield pd.concat(out)

    return work.select("id", "sums").mapInPandas(run, "split long, rank long")


def joined_split_ranks(sums: DataFrame, blocks: int) -> DataFrame:
    """The same for any number of trials: every split joined with the sums of every trial."""
    from itertools import combinations

    splits = [(i, list(c)) for i, c in enumerate(combinations(range(blocks), blocks // 2))]
    splits = sums.sparkSession.createDataFrame(splits, "split long, inside array<int>")
    side = sums.crossJoin(F.broadcast(splits)).withColumn("side", F.when(F.array_contains("inside", F.col("block").cast("int")), "in").otherwise("out"))  # at most C(16, 8) rows of splits
    ratio = side.groupBy("split", "side", "trial").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    ratio = ratio.select("split", "side", "trial", F.when(deviation > 1e-15, mean / deviation).otherwise(0.0).alias("sharpe"))
    inside = ratio.where("side = 'in'").groupBy("split").agg(F.max_by("trial", F.struct("sharpe", -F.col("trial"))).alias("trial"))
    out = ratio.where("side = 'out'").withColumn("rank", F.row_number().over(Window.partitionBy("split").orderBy("sharpe", "trial")) - 1)
    return out.join(inside, ["split", "trial"]).select("split", F.col("rank").cast("long").alias("rank"))


def draw(trial: Column, i: Column, seed: int) -> Column:
    """A portable pseudo-random integer in [0, 2^31) of a trial and a place."""
    m = F.lit(2147483647).cast("long")
    x = (trial * 48271 + i * 69621 + seed) % m
    x = (x * 48271 + 11) % m
    x = (x * 69621 + i) % m
    return (x * 48271) % m


SQL_DRAW = "((((({t} * 48271 + {i} * 69621 + {s}) % 2147483647 * 48271 + 11) % 2147483647 * 69621 + {i}) % 2147483647 * 48271) % 2147483647)"


def bootstrap(values: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """Means of ``trials`` samples with replacement: (trial, mean). ``values(i, x)`` numbers the values from 0.

    Place i of each trial takes the value that its draw names: an equi-join on the number, partial sums per trial. The
    values are written first, so that the planner knows their size and sends them to the draws if they are few.
    """
    spark = values.sparkSession
    values = materialize(values, "values")
    count = values.agg(F.count("*").alias("n"))
    places = values.select("i").crossJoin(F.broadcast(spark.range(trials).toDF("trial"))).crossJoin(F.broadcast(count))  # trials and one row
    picks = places.select("trial", (draw(F.col("trial"), F.col("i"), seed) % F.col("n")).alias("i"))
    return picks.join(values, "i").groupBy("trial").agg(F.avg("x").alias("mean"))


def sign_flips(values: DataFrame, trials: int, seed: int = 7) -> DataFrame:
    """Means of ``trials`` random sign changes of the values: (trial, mean)."""
    spark = values.sparkSession
    places = values.crossJoin(F.broadcast(spark.range(trials).toDF("trial")))
    sign = F.when(draw(F.col("trial"), F.col("i"), seed) % 2 == 0, 1.0).otherwise(-1.0)
    return places.groupBy("trial").agg(F.avg(sign * F.col("x")).alias("mean"))


def walk_forward_folds(rows: DataFrame, folds: int = 5, min_train: float = 0.5) -> DataFrame:
    """(fold, part, first, last, n): expanding train ranges and the test ranges after them over numbered rows (``n`` from 1)."""
    share = (1 - min_train) / folds
    plan = rows.agg(F.max("n").alias("total")).select("total", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    cut = F.floor(F.col("total") * (F.lit(min_train) + F.col("fold") * share))
    end = F.when(F.col("fold") == folds - 1, F.col("total")).otherwise(F.floor(F.col("total") * (F.lit(min_train) + (F.col("fold") + 1) * share)))
    parts = F.array(F.struct(F.lit("train").alias("part"), F.lit(1).cast("long").alias("first"), cut.alias("last")), F.struct(F.lit("test").alias("part"), (cut + 1).alias("first"), end.alias("last")))
    return plan.select("fold", F.inline(parts)).withColumn("n", F.col("last") - F.col("first") + 1)
