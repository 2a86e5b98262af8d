"""Unit-root and level-stationarity tests of many series at once, from sums over tiles.

A tile brings the rows before it that its lags reach back on. It adds up the normal equations of the lagged
differences and the lagged products of the deviations; sums over tiles are all that the statistics need.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from .tiles import spread

LEAST = 20  # shorter series are left out

#: Published response surface of the unit-root statistic with a constant. Its p-value is the normal
#: distribution of a polynomial in the statistic, one up to the middle and another above it.
SURFACE_LOWEST, SURFACE_MIDDLE, SURFACE_HIGHEST = -18.83, -1.61, 2.74
SURFACE_LOW = (2.1659, 1.4412, 0.038269)
SURFACE_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
#: Published critical values of the level-stationarity statistic and their probabilities.
LEVEL_CRITICAL = (0.347, 0.463, 0.574, 0.739)
LEVEL_PROBABILITY = (0.10, 0.05, 0.025, 0.01)

RESULT = "n long, adf double, adf_p double, adf_lags int, kpss double, kpss_p double, kpss_lags int, verdict string"


def most_lags(n: int) -> int:
    """Lagged differences that the unit-root regression may have."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def first_lags(n: int) -> int:
    """Lags from which the level test's bandwidth is estimated."""
    return int(n ** (2 / 9))


def widest(n: int) -> int:
    """A bound on the level test's bandwidth: the ratio it is estimated from is at most ``first_lags``, but for noise."""
    return min(n - 1, int(1.1447 * (2 * first_lags(n)) ** (2 / 3) * n ** (1 / 3)) + 1)


def unit_root_probability(statistic: float) -> float:
    if statistic > SURFACE_HIGHEST:
        return 1.0
    if statistic < SURFACE_LOWEST:
        return 0.0
    powers = SURFACE_LOW if statistic <= SURFACE_MIDDLE else SURFACE_HIGH
    return 0.5 * math.erfc(-sum(c * statistic**i for i, c in enumerate(powers)) / math.sqrt(2))


def regressors(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows (level before, constant, newest ``lags`` differences, difference) for each place after lags + 1 values."""
    d = np.diff(x)
    count = len(d) - lags
    columns = [x[lags:-1], np.ones(count), *(d[lags - i : len(d) - i] for i in range(1, lags + 1)), d[lags:]]
    return np.column_stack(columns)


def fit(cross: np.ndarray, lags: int) -> tuple[float, float]:
    """(sum of squared residuals, t statistic of the level) from the cross products of ``regressors``, with the first ``lags`` differences."""
    used = np.arange(lags + 2)
    scale = np.sqrt(np.maximum(np.diag(cross)[used], 1e-300))
    a = cross[np.ix_(used, used)] / np.outer(scale, scale)
    b = cross[used, -1] / scale
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    rest = max(float(cross[-1, -1] - b @ beta), 0.0)
    free = cross[1, 1] - len(used)
    spread_of_level = math.sqrt(rest / free * inverse[0, 0]) if free > 0 and rest > 0 else 0.0
    return rest, beta[0] / spread_of_level if spread_of_level > 0 else math.nan


def unit_root(n: int, cross: np.ndarray, head: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags): lags by the least information criterion over the places that all of them have, then fitted over all its own.

    ``head`` has the first values of the series, which a regression of fewer lags uses besides.
    """
    top = len(cross) - 3
    places = cross[1, 1]
    criteria = [places * math.log(max(fit(cross, p)[0], 1e-300) / places) + 2 * (p + 2) for p in range(top + 1)]
    best = int(np.argmin(criteria))
    own = np.zeros((best + 3, best + 3))
    kept = [*range(best + 2), len(cross) - 1]
    own += cross[np.ix_(kept, kept)]
    if best < top:
        early = regressors(head[: top + 1], best)
        own += early.T @ early
    statistic = fit(own, best)[1]
    return (0.0, 1.0, best) if math.isnan(statistic) else (statistic, unit_root_probability(statistic), best)


def level_stationarity(n: int, products: np.ndarray, squares: float) -> tuple[float, float, int]:
    """(statistic, p, bandwidth) from lagged products of deviations and the sum of squares of their running sums."""
    s0, s1 = products[0] / n, 0.0
    for i in range(1, first_lags(n) + 1):
        s0 += 2 * products[i] / n
        s1 += 2 * i * products[i] / n
    ratio = s1 / s0 if s0 else 0.0
    width = min(int(1.1447 * (ratio * ratio) ** (1 / 3) * n ** (1 / 3)), n - 1, len(products) - 1)
    weights = 1 - np.arange(1, width + 1) / (width + 1)
    variance = (products[0] + 2 * float(weights @ products[1 : width + 1])) / n
    if variance <= 0:
        return 0.0, 1.0, width
    statistic = squares / n**2 / variance
    return statistic, float(np.interp(statistic, LEVEL_CRITICAL, LEVEL_PROBABILITY)), width


def verdict(adf_p: float, kpss_p: float, significance: float) -> str:
    rejects_root, keeps_level = adf_p < significance, kpss_p >= significance
    if rejects_root:
        return "STATIONARY" if keeps_level else "TREND-STATIONARY"
    return "INCONCLUSIVE" if keeps_level else "NON-STATIONARY"


def stationarity_tests(values: DataFrame, by: tuple[str, ...], x: str = "x", order: tuple[str, ...] = ("ts", "seq"), tile_rows: int = 10_000, significance: float = 0.05) -> DataFrame:
    """For each series ``by``: the augmented Dickey-Fuller and the KPSS test with a constant, and what they say together.

    Returns ``by, n, adf, adf_p, adf_lags, kpss, kpss_p, kpss_lags, verdict``. Values that are null or not finite are left
    out, then series of fewer than 20 values. A constant series has statistic 0 and probability 1 in both tests. Lags of
    the first are chosen by AIC up to 12 (n / 100)^(1/4), the bandwidth of the second from the data; probabilities of
    the second end at 0.1 and 0.01. ``order[0]`` is a time.
    """
    spark = values.sparkSession
    ship_package(spark)
    finite = values.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    series = finite.select(F.struct(*by).alias("series"), *order, F.col(x).cast("double").alias("x"))
    sizes = materialize(series.groupBy("series").agg(F.count("*").alias("size"), F.avg("x").alias("mean")).where(F.col("size") >= LEAST), "series")
    longest = sizes.agg(F.max("size")).first()[0] or LEAST
    reach = max(most_lags(longest) + 1, widest(longest))
    tiles = spread(series.join(sizes, "series"), lookback=reach, tile_rows=tile_rows, key="series", order=order)
    tiles = tiles.where(F.col("tile") * tile_rows < F.col("size"))  # not those of copies alone, past the end
    kind = series.schema["series"].dataType.simpleString()

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable")
        size, mean = int(rows["size"].iloc[0]), rows["mean"].iloc[0]
        e = rows["x"].to_numpy(float) - mean
        own = int(((rows["tile"] == rows["own"])).sum())
        before = len(e) - own
        lags, width = most_lags(size), widest(size)
        z = regressors(e[max(0, before - lags - 1) :], lags) if len(e) - max(0, before - lags - 1) > lags + 1 else np.zeros((0, lags + 3))
        products = [float(e[max(before, i) :] @ e[max(before, i) - i : len(e) - i]) if i < len(e) else 0.0 for i in range(width + 1)]
        run = np.cumsum(e[before:])
        head = e[before:][rows["n"].to_numpy()[before:] <= lags + 1].tolist()
        parts = [*(z.T @ z).ravel().tolist(), *products]
        return pd.DataFrame({"series": [rows["series"].iloc[0]], "tile": rows["tile"].iloc[0], "count": own, "total": run[-1], "running": run.sum(), "squares": run @ run, "parts": [parts], "head": [head]})

    schema = f"series {kind}, tile long, count long, total double, running double, squares double, parts array<double>, head array<double>"
    by_tile = materialize(tiles.groupBy("series", "tile").applyInPandas(sums, schema), "tile-sums")
    # running sums of a tile go on from the total of the tiles before it
    start = F.coalesce(F.sum("total").over(Window.partitionBy("series").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = by_tile.drop("parts").withColumn("start", start).groupBy("series").agg(
        F.sum("count").alias("n"),
        F.sum(F.col("count") * F.col("start") ** 2 + 2 * F.col("start") * F.col("running") + F.col("squares")).alias("squares"),
    )
    first = F.array_sort(F.collect_list(F.when(F.size("head") > 0, F.struct("tile", "head"))))
    head = by_tile.groupBy("series").agg(F.flatten(first["head"]).alias("head"))
    parts = by_tile.select("series", F.posexplode("parts").alias("place", "part")).groupBy("series", "place").agg(F.sum("part").alias("part"))
    parts = parts.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    whole = squares.join(parts, "series").join(head, "series").select("series", "n", "squares", F.col("parts")["part"].alias("parts"), "head")

    def test(batches):
        for rows in batches:
            out = []
            for series, n, squares, parts, head in zip(rows["series"], rows["n"], rows["squares"], rows["parts"], rows["head"]):
                wide = most_lags(n) + 3
                cross, products = np.array(parts[: wide * wide]).reshape(wide, wide), np.array(parts[wide * wide :])
                if products[0] <= 0:
                    found = (0.0, 1.0, 0, 0.0, 1.0, 0)
                else:
                    found = (*unit_root(n, cross, np.array(head)), *level_stationarity(n, products, squares))
                out.append((series, n, *found, verdict(found[1], found[4], significance)))
            yield pd.DataFrame(out, columns=["series", "n", "adf", "adf_p", "adf_lags", "kpss", "kpss_p", "kpss_lags", "verdict"])

    return whole.mapInPandas(test, f"series {kind}, {RESULT}").select("series.*", "n", "adf", "adf_p", "adf_lags", "kpss", "kpss_p", "kpss_lags", "verdict")
