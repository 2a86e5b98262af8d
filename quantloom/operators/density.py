"""Densities of return windows: mixtures, kernels, entropy, divergence, shape over time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..cluster import default_parallelism, ship_package
from ..functions.normal import quantile as normal_quantile
from .performance import draw
from .tiles import stretched
from .windows import SYMBOL, ordered

MIXTURE = "weights array<double>, means array<double>, vars array<double>, bic double"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def window_arrays(rows: DataFrame, n: int = 150, every: int = 10, keys=SYMBOL) -> DataFrame:
    """The evaluation rows, each with ``window``, the last n returns as an array.

    Rows carry their number ``n`` within the symbol; other rows are needed as they hold the returns, and go.
    ``keys`` should be tiles, as each partition is handed over whole.
    """
    ship_package(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField("window", ArrayType(DoubleType()))])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "seq"], kind="stable").reset_index(drop=True)
        ret = part["ret"].to_numpy(float)
        chosen = part[(part["n"] > n) & (part["n"] % every == 0)]
        windows = [ret[max(0, i - n + 1) : i + 1] for i in chosen.index]
        return chosen.assign(window=pd.Series([w[~np.isnan(w)] for w in windows], index=chosen.index, dtype=object))

    return rows.groupBy(*keys).applyInPandas(run, schema)


def fit_mixtures(x: np.ndarray, most: int = 4, rounds: int = 60) -> list[tuple]:
    """Gaussian mixtures of 1 to ``most`` parts with the least BIC, by EM from quantiles: (weights, means, vars, bic) for each row of values.

    All rows take their steps together, as one array operation each, over arrays of parts, rows and values that are
    filled again in every round.
    """
    count, n = x.shape
    var = x.var(axis=1)
    floor = np.maximum(var * 1e-4, 1e-18)
    best: list = [None] * count
    for k in range(1, most + 1):
        square, p, one = np.empty((k, count, n)), np.empty((k, count, n)), np.empty((count, n))

        def squares(means):
            np.subtract(x, means[:, :, None], out=square)
            np.multiply(square, square, out=square)

        def over_parts(combine):
            np.copyto(one, p[0])
            for part in p[1:]:
                combine(one, part, out=one)

        def expect(weights, spread):
            """``p`` becomes each part's density over the greatest part's; the logs of the greatest are returned."""
            np.multiply(square, (-0.5 / spread)[:, :, None], out=p)
            np.add(p, (np.log(weights) - 0.5 * np.log(2 * np.pi * spread))[:, :, None], out=p)
            over_parts(np.maximum)
            top = one.copy()
            np.subtract(p, top, out=p)
            np.exp(p, out=p)
            over_parts(np.add)
            return top

        means = np.quantile(x, (np.arange(k) + 0.5) / k, axis=1)
        weights = np.full((k, count), 1 / k)
        spread = np.repeat(np.maximum(var, floor)[None], k, axis=0)
        squares(means)
        for _ in range(rounds if k > 1 else 1):
            expect(weights, spread)
            np.divide(p, one, out=p)
            mass = p.sum(axis=2) + 1e-12
            weights, means = mass / mass.sum(axis=0), np.einsum("kcn,cn->kc", p, x) / mass
            squares(means)
            spread = np.maximum(np.einsum("kcn,kcn->kc", p, square) / mass, floor)
        likelihood = (expect(weights, spread) + np.log(one)).sum(axis=1)
        bic = -2 * likelihood + (3 * k - 1) * math.log(n)
        for i in range(count):
            if best[i] is None or bic[i] < best[i][3]:
                best[i] = (weights[:, i].tolist(), means[:, i].tolist(), spread[:, i].tolist(), float(bic[i]))
    return best


def fit_mixture(x: np.ndarray, most: int = 4, rounds: int = 60) -> tuple | None:
    """The same for one array, whose values that are not finite go; None with fewer than 20 others."""
    x = x[np.isfinite(x)]
    return fit_mixtures(x[None], most, rounds)[0] if len(x) >= 20 else None


def mixtures(rows: DataFrame, at_once: int = 64) -> DataFrame:
    """``weights, means, vars, bic`` of each row's ``window``, fitted in Arrow batches, windows of one length together; null for too short windows."""
    ship_package(rows.sparkSession)

    @F.pandas_udf(MIXTURE)
    def fit(windows: pd.Series) -> pd.DataFrame:
        values = [np.asarray(w, float) for w in windows]
        values = [v[np.isfinite(v)] for v in values]
        found: list = [(None, None, None, None)] * len(values)
        for n in sorted({len(v) for v in values if len(v) >= 20}):
            same = [i for i, v in enumerate(values) if len(v) == n]
            for low in range(0, len(same), at_once):
                part = same[low : low + at_once]
                for i, mixture in zip(part, fit_mixtures(np.array([values[i] for i in part]))):
                    found[i] = mixture
        return pd.DataFrame(found, columns=["weights", "means", "vars", "bic"])

    # a fit takes milliseconds: windows are dealt over all tasks, however few bytes they are
    rows = rows.repartition(default_parallelism(rows.sparkSession))
    return rows.withColumn("__m", fit("window")).select(*rows.columns, "__m.*")


def mixture_values(x: np.ndarray, weights, means, spread) -> np.ndarray:
    """Density of a mixture at every point."""
    w, m, v = (np.asarray(p, float)[:, None] for p in (weights, means, spread))
    return (w / np.sqrt(2 * np.pi * v) * np.exp(-((x - m) ** 2) / (2 * v))).sum(axis=0)


def mixture_density(low: Column, high: Column, weights: Column, means: Column, spread: Column, points: int) -> Column:
    """Density of a mixture at ``points`` even places from ``low`` to ``high``, in Arrow batches; null where a part is null."""

    @F.pandas_udf("array<double>")
    def evaluate(low: pd.Series, high: pd.Series, weights: pd.Series, means: pd.Series, spread: pd.Series) -> pd.Series:
        rows = zip(low, high, weights, means, spread)
        return pd.Series([None if w is None or a is None else mixture_values(np.linspace(a, b, points), w, m, v) for a, b, w, m, v in rows], dtype=object)

    return evaluate(low, high, weights, means, spread)


def mixture_divergence(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column], points: int = 1000, deviations: float = 5.0) -> Column:
    """Divergence of mixture ``p`` from ``q`` on one grid that holds so many deviations of every part of both; null if one is null."""

    @F.pandas_udf("double")
    def evaluate(pw: pd.Series, pm: pd.Series, pv: pd.Series, qw: pd.Series, qm: pd.Series, qv: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(zip(pw, pm, pv), zip(qw, qm, qv)):
            if a[0] is None or b[0] is None:
                out.append(None)
                continue
            means, reach = np.concatenate([a[1], b[1]]), deviations * np.sqrt(np.concatenate([a[2], b[2]]))
            x = np.linspace((means - reach).min(), (means + reach).max(), points)
            out.append(divergence_of(mixture_values(x, *a), mixture_values(x, *b), x[1] - x[0]))
        return pd.Series(out, dtype=float)

    return evaluate(*p, *q)


def divergence_of(p: np.ndarray, q: np.ndarray, step: float, eps: float = 1e-12) -> float:
    """Kullback-Leibler divergence of two densities on one grid, each brought to mass 1 first; at least 0."""
    p, q = p / (p.sum() * step), q / (q.sum() * step)
    both = (p > eps) & (q > eps)
    return max(0.0, float((p[both] * np.log(p[both] / q[both])).sum() * step))


#: What ``measures`` adds.
MEASURES = "mass double, entropy double, log_density double, tail_ratio double"
#: What ``moves`` adds.
MOVES = "velocity double, bifurcation double, peak double, entropy double, change double, collapsed boolean, spread_90 double"


def entropy_of(pdf: np.ndarray, step: float) -> float:
    """-sum p ln p dx over a density's grid."""
    p = pdf[pdf > 1e-300]
    return float(-(p * np.log(p)).sum() * step)


def grid_of(values: np.ndarray, points: int, deviations: float = 4.0) -> np.ndarray:
    """Even places over so many sample deviations on both sides of the mean of an array."""
    mu, sigma = values.mean(), max(values.std(ddof=1), 1e-12)
    return np.linspace(mu - deviations * sigma, mu + deviations * sigma, points)


def tail_ratio_of(values: np.ndarray, mixture: tuple, share: float = 0.95) -> float:
    """``tail_ratio`` of one array."""
    mean = values.mean()
    variance = max((values * values).mean() - mean * mean, 1e-18)
    at = np.quantile(values, share)
    gauss = np.exp(-(at - mean) * (at - mean) / (2 * variance)) / np.sqrt(2 * np.pi * variance)
    return float(mixture_values(np.array([at]), *mixture)[0] / max(gauss, 1e-300))


def measures(rows: DataFrame, points: int = 1000) -> DataFrame:
    """``mass, entropy, log_density, tail_ratio`` of the mixture of each row's ``window`` on its grid (``grid_of``), in Arrow batches; null without one."""
    ship_package(rows.sparkSession)

    @F.pandas_udf(MEASURES)
    def measure(window: pd.Series, weights: pd.Series, means: pd.Series, spread: pd.Series) -> pd.DataFrame:
        out = []
        for values, *mixture in zip(window, weights, means, spread):
            if mixture[0] is None:
                out.append((None,) * 4)
                continue
            x = grid_of(values, points)
            pdf, step = mixture_values(x, *mixture), (x[-1] - x[0]) / (points - 1)
            at_values = np.log(np.maximum(mixture_values(values, *mixture), 1e-300))
            out.append((pdf.sum() * step, entropy_of(pdf, step), at_values.mean(), tail_ratio_of(values, mixture)))
        return pd.DataFrame(out, columns=["mass", "entropy", "log_density", "tail_ratio"]).astype(float)

    return rows.withColumn("__measures", measure("window", "weights", "means", "vars")).select(*rows.columns, "__measures.*")


def with_earlier(rows: DataFrame, columns: tuple[str, ...], back: int = 1, number: str = "k", key: str = "symbol") -> DataFrame:
    """``rows`` with ``was_1_*`` to ``was_{back}_*``: ``columns`` of the rows before, where ``number`` counts a key's rows without gaps."""

    def features(d, keys):
        w = Window.partitionBy(*keys).orderBy(number)
        return d.withColumns({f"was_{i}_{c}": F.lag(c, i).over(w) for i in range(1, back + 1) for c in columns})

    return stretched(rows, back, features, number, key)


def moves(rows: DataFrame, points: int = 1000, peak: float = 1000.0, key: str = "symbol") -> DataFrame:
    """What ``surface`` and ``shape`` say of the mixture densities of each row's ``window`` on its grid, and their ``entropy``.

    Only the mixtures and the ends of the grids move to the row after; densities are made in Arrow batches, two at a
    time, and none is stored. ``k`` counts the rows of a key.
    """
    ship_package(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def ends(window: pd.Series) -> pd.Series:
        return pd.Series([grid_of(w, points)[[0, -1]] if len(w) > 1 else None for w in window], dtype=object)

    @F.pandas_udf(MOVES)
    def move(window: pd.Series, now: pd.DataFrame, was: pd.DataFrame) -> pd.DataFrame:
        def density(ends, weights, means, spread):
            return None if weights is None or ends is None else mixture_values(np.linspace(*ends, points), weights, means, spread)

        out = []
        for values, a, b in zip(window, now.itertuples(index=False, name=None), was.itertuples(index=False, name=None)):
            reach = float(np.subtract(*np.quantile(values, [0.95, 0.05]))) if len(values) else None
            pdf, before = density(*a), density(*b)
            if pdf is None:
                out.append((0.0, None, None, None, 0.0, None, reach))
                continue
            high = pdf.max()
            gap = np.zeros(1) if before is None else pdf - before
            step = (a[0][1] - a[0][0]) / (points - 1)
            out.append((np.abs(gap).mean(), np.flatnonzero(pdf > high / 2).std(), high, entropy_of(pdf, step), np.sqrt((gap * gap).sum()), high > peak, reach))
        return pd.DataFrame(out, columns=["velocity", "bifurcation", "peak", "entropy", "change", "collapsed", "spread_90"])

    rows = rows.withColumn("ends", ends("window"))
    mixture = ("ends", "weights", "means", "vars")
    moved = with_earlier(rows, mixture, 1, key=key)
    now, was = F.struct(*mixture), F.struct(*(f"was_1_{c}" for c in mixture))
    moved = moved.withColumn("__moves", move("window", now, was)).select(*(c for c in rows.columns if c not in ("ends", "window")), "__moves.*")
    moved = with_earlier(moved, ("peak",), 2, key=key)
    v0, v1, v2 = F.col("peak"), F.col("was_1_peak"), F.col("was_2_peak")
    return moved.withColumns({"slope": v0 - v1, "curvature": (v0 - v1) - (v0 - v2) / 2}).drop("was_1_peak", "was_2_peak")


def density_at(x: Column, weights: Column, means: Column, spread: Column) -> Column:
    """Density of a mixture at one point."""
    parts = F.arrays_zip(weights.alias("w"), means.alias("m"), spread.alias("v"))
    return total(F.transform(parts, lambda c: c["w"] / F.sqrt(2 * math.pi * c["v"]) * F.exp(-(x - c["m"]) * (x - c["m"]) / (2 * c["v"]))))


def kernel_density(x: Column, values: Column) -> Column:
    """Gaussian kernel density of an array of values at every point of another, with the width of Scott's rule; in Arrow batches."""

    @F.pandas_udf("array<double>")
    def evaluate(x: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for points, v in zip(x, values):
            if points is None or v is None or len(v) < 2:
                out.append(None)
                continue
            h = max(v.std(ddof=1) * len(v) ** -0.2, 1e-12)
            gaps = (np.asarray(points, float)[:, None] - v) / h
            out.append(np.exp(-0.5 * gaps * gaps).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi)))
        return pd.Series(out, dtype=object)

    return evaluate(x, values)


def deviation_of(values: Column) -> Column:
    """Population deviation of an array, in Arrow batches: a mean inside the function of each value would be made anew for each."""

    @F.pandas_udf("double")
    def evaluate(values: pd.Series) -> pd.Series:
        return pd.Series([v.std() if v is not None and len(v) else None for v in values], dtype=float)

    return evaluate(values)


def differential_entropy(pdf: Column, step: Column) -> Column:
    """-sum p ln p dx over a density's grid."""
    return -total(F.transform(pdf, lambda p: F.when(p > 1e-300, p * F.log(p)).otherwise(0.0))) * step


def quantile(values: Column, share: float) -> Column:
    """The linear-interpolated quantile of an array."""
    ranked, n = F.sort_array(values), F.size(values)
    place = (n - 1) * share
    low = F.floor(place).cast("int")
    return F.get(ranked, low) + (F.get(ranked, F.least(low + 1, n - 1)) - F.get(ranked, low)) * (place - low)


def likelihood(values: Column, weights: Column, means: Column, spread: Column) -> Column:
    """Mean log density of an array's values."""
    return total(F.transform(values, lambda x: F.log(F.greatest(density_at(x, weights, means, spread), F.lit(1e-300))))) / F.size(values)


def tail_ratio(values: Column, weights: Column, means: Column, spread: Column, share: float = 0.95) -> Column:
    """Density of the mixture over that of a Gaussian of the same moments, at the ``share`` quantile of an array's values."""
    n = F.size(values)
    mean = total(values) / n
    variance = F.greatest(total(F.transform(values, lambda v: v * v)) / n - mean * mean, F.lit(1e-18))
    at = quantile(values, share)
    gauss = F.exp(-(at - mean) * (at - mean) / (2 * variance)) / F.sqrt(2 * math.pi * variance)
    return density_at(at, weights, means, spread) / F.greatest(gauss, F.lit(1e-300))


def shape(rows: DataFrame, peak: float = 1000.0, keys=SYMBOL) -> DataFrame:
    """``change, collapsed, spread_90``: Euclidean distance of the density ``pdf`` to the one before, whether the density exceeds
    ``peak`` anywhere, and the distance between the 5 and 95 % quantiles of ``window``."""
    rows = rows.withColumn("__was", F.lag("pdf").over(ordered(keys)))
    return rows.withColumns(
        {
            "change": F.coalesce(F.sqrt(total(F.zip_with("pdf", "__was", lambda a, b: (a - b) * (a - b)))), F.lit(0.0)),
            "collapsed": F.array_max("pdf") > peak,
            "spread_90": quantile(F.col("window"), 0.95) - quantile(F.col("window"), 0.05),
        }
    ).drop("__was")


def surface(rows: DataFrame, keys=SYMBOL) -> DataFrame:
    """``velocity, bifurcation, peak, slope, curvature`` of the density ``pdf`` from one evaluation to the next.

    Velocity is the mean absolute change; bifurcation the deviation of the places above half the maximum; slope and
    curvature are end-point gradients of the peak's height.
    """
    w = ordered(keys)
    rows = rows.withColumn("peak", F.array_max("pdf")).withColumn("__was", F.lag("pdf").over(w))
    places = F.filter(F.transform("pdf", lambda p, i: F.when(p > F.col("peak") / 2, i.cast("double"))), lambda x: x.isNotNull())
    rows = rows.withColumn("__p", places)
    mean = total(F.col("__p")) / F.size("__p")
    v0, v1, v2 = F.col("peak"), F.lag("peak", 1).over(w), F.lag("peak", 2).over(w)
    return rows.withColumns(
        {
            "velocity": F.coalesce(total(F.zip_with("pdf", "__was", lambda a, b: F.abs(a - b))) / F.size("pdf"), F.lit(0.0)),
            "bifurcation": F.sqrt(total(F.transform("__p", lambda x: (x - mean) * (x - mean))) / F.size("__p")),
            "slope": v0 - v1,
            "curvature": (v0 - v1) - (v0 - v2) / 2,
        }
    ).drop("__was", "__p")


def nearest_neighbour_entropy(values: Column, k: int = 3) -> Column:
    """Kozachenko-Leonenko entropy of an array in one dimension from the k-th nearest neighbour.

    In sorted order the k nearest of a value are among the k before and the k after it. digamma(n) is taken as
    ln n - 1/(2n) - 1/(12n^2), which is exact to 1e-8 from n = 20 on.
    """
    digamma_k = -0.5772156649015329 + sum(1 / i for i in range(1, k))
    n = F.size(values)

    def at(ordered_values):
        def distance(x, i):
            gaps = F.array(*(F.abs(x - F.get(ordered_values, i + d)) for d in (*range(-k, 0), *range(1, k + 1))))
            near = F.array_sort(F.filter(gaps, lambda g: g.isNotNull()))
            return F.log(2 * F.greatest(F.get(near, F.lit(k - 1)), F.lit(1e-15)))

        return total(F.transform(ordered_values, distance)) / n

    digamma_n = F.log(n.cast("double")) - 1 / (2.0 * n) - 1 / (12.0 * n * n)
    mean_log = F.transform(F.array(F.sort_array(values)), at)[0]
    return F.when(n >= 20, digamma_n - digamma_k + mean_log)


def kernel_draws(windows: DataFrame, values: str, trial: str, draws: int, seed: int = 42, least: int = 10) -> DataFrame:
    """``windows`` with ``draw`` (its number, from 0) and ``sample``: seeded draws from the kernel density of each window.

    A draw takes a value of the window by a portable hash of (trial, draw) and moves it by a normal deviate of the
    kernel's width: Scott's factor times the population deviation. A constant window is drawn from with a deviation of
    1e-8. Windows of fewer than ``least`` values have no rows.
    """
    n = F.size(values)
    ship_package(windows.sparkSession)
    deviation = deviation_of(F.col(values))
    width = F.when(F.col("__deviation") > 0, F.pow(n.cast("double"), F.lit(-0.2)) * F.col("__deviation")).otherwise(1e-8)
    d = windows.where(n >= least).withColumn("__deviation", deviation).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    chosen = (draw(F.col(trial), F.col("draw"), seed) % n).cast("int")
    share = (draw(F.col(trial), F.col("draw"), seed + 1) + 0.5) / 2147483648.0
    return d.withColumn("sample", F.get(F.col(values), chosen) + width * normal_quantile(share)).drop("__deviation")
