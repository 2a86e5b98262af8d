"""Rolling microstructure features: each function adds columns to ticks by windows over their order.

All take ``keys``, the columns that partition the windows: ``("symbol",)``, or symbol and tile inside ``tiles.rolling``.
Rows are ordered by (ts, seq). Windows are counted in rows unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..cluster import ship_package
from .carried import mean_of_newest

SYMBOL = ("symbol",)


def ordered(keys=SYMBOL):
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def last(n: int, keys=SYMBOL):
    """The newest row and n - 1 before it."""
    return ordered(keys).rowsBetween(1 - n, 0)


def before(n: int, keys=SYMBOL):
    """The n rows before the newest."""
    return ordered(keys).rowsBetween(-n, -1)


def so_far(keys=SYMBOL):
    return ordered(keys).rowsBetween(Window.unboundedPreceding, 0)


def _two_parts(df: DataFrame, n: int, keys, newest: int, order, parts: dict[str, Callable]) -> DataFrame:
    """Aggregates of the n rows that end ``newest`` rows before this one, in two parts that do not overlap: ``a_*`` the older rows, ``b_*`` the newer.

    A partition is cut into blocks of n rows. Such a window is the end of one block and the beginning of the next, and
    each block is aggregated from its first row on and from its last row back. So a row costs the same whatever n is,
    nothing is subtracted, and a value that has left the window leaves no trace. ``parts`` make a column over a window.
    """
    start = Window.unboundedPreceding
    df = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("__block", F.floor(F.col("__at") / n))
    block, at = Window.partitionBy(*keys, "__block"), Window.partitionBy(*keys).orderBy("__at")
    df = df.withColumns({f"b_{c}": make(block.orderBy("__at").rowsBetween(start, 0)) for c, make in parts.items()})
    df = df.withColumns({f"a_{c}": make(block.orderBy(F.desc("__at")).rowsBetween(start, 0)) for c, make in parts.items()})
    whole = F.pmod(F.col("__at") - newest, F.lit(n)) == n - 1  # the newer part is a whole block
    older = {f"a_{c}": F.when(~whole, F.lag(f"a_{c}", n - 1 + newest).over(at)) for c in parts}
    newer = {f"b_{c}": F.lag(f"b_{c}", newest).over(at) for c in parts} if newest else {}
    return df.withColumns(older | newer).drop("__at", "__block")


def sliding_sums(df: DataFrame, values: dict[str, Column], n: int, keys=SYMBOL, newest: int = 0, order=("ts", "seq")) -> DataFrame:
    """Each of ``values`` summed over the n rows that end ``newest`` rows before this one; nulls count as 0."""
    df = df.withColumns({f"__v_{c}": v.cast("double") for c, v in values.items()})
    df = _two_parts(df, n, keys, newest, order, {c: lambda w, c=c: F.sum(f"__v_{c}").over(w) for c in values})
    zero = F.lit(0.0)
    df = df.withColumns({c: F.coalesce(f"a_{c}", zero) + F.coalesce(f"b_{c}", zero) for c in values})
    return df.drop(*(f"{p}_{c}" for c in values for p in ("a", "b", "__v")))


def _present(col: str) -> Column:
    return F.when(F.col(col).isNotNull(), 1.0)


def sliding_moments(df: DataFrame, col: str, n: int, keys=SYMBOL, newest: int = 0, powers: int = 2, order=("ts", "seq")) -> DataFrame:
    """``__n, __mean, __m2`` (and ``__m3, __m4``): count, mean and central power means of a column over the sliding rows.

    The central moments of the two parts of a window are put together without raw powers, so neither a large mean nor an
    outlier that has left the window costs digits. A window of one value has no spread at all.
    """
    moments = {"n": F.count, "mean": F.avg, "var": F.var_pop, "low": F.min, "high": F.max}
    if powers == 4:
        moments |= {"skew": F.skewness, "kurt": F.kurtosis}
    df = _two_parts(df, n, keys, newest, order, {c: lambda w, f=f: f(col).over(w) for c, f in moments.items()})
    zero = F.lit(0.0)
    at = lambda c, p: F.coalesce(F.nanvl(f"{p}_{c}", zero) if c in ("skew", "kurt") else F.col(f"{p}_{c}"), zero)
    df = df.withColumns({f"{p}_n": at("n", p).cast("double") for p in "ab"})
    na, nb = F.col("a_n"), F.col("b_n")
    count = na + nb
    gap = F.when((na > 0) & (nb > 0), F.col("b_mean") - F.col("a_mean")).otherwise(0.0)
    mean = F.when(na > 0, F.col("a_mean") + gap * nb / count).when(nb > 0, F.col("b_mean"))
    low, high = F.least("a_low", "b_low"), F.greatest("a_high", "b_high")
    flat = low == high
    m2 = {p: at("var", p) * at("n", p) for p in "ab"}
    some, d = count > 0, gap
    square = m2["a"] + m2["b"] + d * d * na * nb / count
    out = {"__n": count, "__mean": F.when(flat, low).otherwise(mean), "__m2": F.when(flat, 0.0).when(some, square / count)}
    if powers == 4:
        m3 = {p: at("skew", p) * F.pow(m2[p], F.lit(1.5)) / F.sqrt(F.greatest(at("n", p), F.lit(1.0))) for p in "ab"}
        m4 = {p: F.when(m2[p] > 0, (at("kurt", p) + 3) * m2[p] * m2[p] / F.greatest(at("n", p), F.lit(1.0))).otherwise(0.0) for p in "ab"}
        cube = m3["a"] + m3["b"] + d**3 * na * nb * (na - nb) / (count * count) + 3 * d * (na * m2["b"] - nb * m2["a"]) / count
        fourth = m4["a"] + m4["b"] + d**4 * na * nb * (na * na - na * nb + nb * nb) / count**3
        fourth = fourth + 6 * d * d * (na * na * m2["b"] + nb * nb * m2["a"]) / (count * count) + 4 * d * (na * m3["b"] - nb * m3["a"]) / count
        out |= {"__m3": F.when(flat, 0.0).when(some, cube / count), "__m4": F.when(flat, 0.0).when(some, fourth / count)}
    return df.withColumns(out).drop(*(f"{p}_{c}" for c in moments for p in "ab"))


def log_returns(df: DataFrame, keys=SYMBOL) -> DataFrame:
    """``ret``: log of price over the price before; null on a symbol's first row."""
    return df.withColumn("ret", F.log(F.col("price") / F.lag("price").over(ordered(keys))))


def moments(df: DataFrame, n: int = 150, keys=SYMBOL) -> DataFrame:
    """``mu, sigma, skew, kurt`` of the last n returns: sample deviation, population skewness and excess kurtosis.

    All four are 0 with fewer than 10 returns; skewness and kurtosis are 0 where the deviation is.
    """
    df = sliding_moments(df, "ret", n, keys, powers=4)
    count, m2 = F.col("__n"), F.col("__m2")
    few = count < 10
    flat = few | (m2 <= 0)
    return df.withColumns(
        {
            "mu": F.when(few, 0.0).otherwise(F.col("__mean")),
            "sigma": F.when(few, 0.0).otherwise(F.sqrt(m2 * count / (count - 1))),
            "skew": F.when(flat, 0.0).otherwise(F.col("__m3") / F.pow(m2, F.lit(1.5))),
            "kurt": F.when(flat, 0.0).otherwise(F.col("__m4") / (m2 * m2) - 3),
        }
    ).drop("__n", "__mean", "__m2", "__m3", "__m4")


def zscore(df: DataFrame, col: str = "price", n: int = 1000, keys=SYMBOL) -> DataFrame:
    """``z`` of a column in the last n rows, itself included; 0 where the sample deviation is 0, the distance to the mean on the first row."""
    df = sliding_moments(df, col, n, keys)
    deviation = F.when(F.col("__n") > 1, F.sqrt(F.col("__m2") * F.col("__n") / (F.col("__n") - 1)))
    distance = F.col(col) - F.col("__mean")
    return df.withColumn("z", F.when(deviation.isNull(), F.col(col)).when(deviation == 0, 0.0).otherwise(distance / deviation)).drop("__n", "__mean", "__m2")


def momentum(df: DataFrame, keys=SYMBOL) -> DataFrame:
    """``mom_50, mom_200``: sums of the 50 and 200 returns before the newest; 0 until there are as many."""
    for n in (50, 200):
        df = sliding_sums(df, {"__n": _present("ret"), "__s": F.col("ret")}, n, keys, newest=1)
        df = df.withColumn(f"mom_{n}", F.when(F.col("__n") < n, 0.0).otherwise(F.col("__s"))).drop("__n", "__s")
    return df


def mean_reversion(df: DataFrame, n: int = 200, keys=SYMBOL) -> DataFrame:
    """``mean_rev``: distance of the price from the mean of the last n in population deviations; 0 with fewer than 50."""
    df = sliding_moments(df, "price", n, keys)
    deviation = F.sqrt("__m2")
    value = F.when((F.col("__n") < 50) | (deviation < 1e-12), 0.0).otherwise((F.col("price") - F.col("__mean")) / deviation)
    return df.withColumn("mean_rev", value).drop("__n", "__mean", "__m2")


def order_flow_imbalance(df: DataFrame, keys=SYMBOL) -> DataFrame:
    """``ofi``: bid side minus ask side flow at the best quotes; on the first row prices count as unchanged from size 0."""
    w = ordered(keys)
    bid, ask = F.coalesce("bid", "price"), F.coalesce("ask", "price")
    bid_size, ask_size = F.coalesce("bid_size", F.lit(0.0)), F.coalesce("ask_size", F.lit(0.0))
    was_bid, was_ask = F.coalesce(F.lag(bid).over(w), bid), F.coalesce(F.lag(ask).over(w), ask)
    was_bid_size, was_ask_size = F.coalesce(F.lag(bid_size).over(w), F.lit(0.0)), F.coalesce(F.lag(ask_size).over(w), F.lit(0.0))
    bid_flow = F.when(bid > was_bid, bid_size).when(bid < was_bid, -was_bid_size).otherwise(bid_size - was_bid_size)
    ask_flow = F.when(ask < was_ask, ask_size).when(ask > was_ask, -was_ask_size).otherwise(ask_size - was_ask_size)
    return df.withColumn("ofi", bid_flow - ask_flow)


def book_slope(df: DataFrame) -> DataFrame:
    """``slope``: difference of the best sizes over the spread, which counts as 0.01 at least."""
    return df.withColumn("slope", (F.col("bid_size") - F.col("ask_size")) / F.greatest(F.lit(0.01), F.col("ask") - F.col("bid")))


def ofi_zscore(df: DataFrame, n: int = 200, keys=SYMBOL) -> DataFrame:
    """``ofi_std, ofi_z``: population deviation of the last n imbalances (1 with fewer than 20, at least 1e-8) and the imbalance over it."""
    df = sliding_moments(df, "ofi", n, keys)
    deviation = F.when(F.col("__n") < 20, 1.0).otherwise(F.greatest(F.sqrt("__m2"), F.lit(1e-8)))
    return df.withColumn("ofi_std", deviation).withColumn("ofi_z", F.col("ofi") / F.col("ofi_std")).drop("__n", "__mean", "__m2")


def flow(df: DataFrame, n: int = 150, keys=SYMBOL) -> DataFrame:
    """``ofi_sum, toxicity, intensity`` of the last n rows: imbalance, imbalance over volume, volume over seconds."""
    df = sliding_sums(df, {"ofi_sum": F.col("ofi"), "__volume": F.col("volume")}, n, keys)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.first(at).over(last(n, keys))
    span = (at - first) / 1e6
    return df.withColumns(
        {
            "toxicity": F.col("ofi_sum") / F.greatest("__volume", F.lit(1.0)),
            "intensity": F.when(span > 0, F.col("__volume") / span).otherwise(0.0),
        }
    ).drop("__volume")


def spread_stats(rows: DataFrame, n: int = 20) -> DataFrame:
    """``mean_spread, spread_frac``: mean of the last n valid spreads (ask above bid), over any distance, and its share of the mid.

    ``rows`` come in tiles.
    """
    rows = mean_of_newest(rows, F.when(F.col("ask") > F.col("bid"), F.col("ask") - F.col("bid")), n, "mean_spread")
    mid = (F.col("bid") + F.col("ask")) / 2
    return rows.withColumn("spread_frac", F.when(mid > 0, F.col("mean_spread") / mid).otherwise(0.0))


def kyle_lambda(df: DataFrame, n: int = 100, keys=SYMBOL) -> DataFrame:
    """``kyle``: sample covariance of mid changes and signed volume over the population variance of the latter; 0 with fewer than 20 pairs."""
    mid = (F.col("bid") + F.col("ask")) / 2
    change = mid - F.lag(mid).over(ordered(keys))
    signed = F.when(change.isNotNull(), F.col("volume") * F.signum(F.col("price") - F.lag("price").over(ordered(keys))))
    df = df.withColumn("__c", change).withColumn("__v", signed)
    sums = {"__n": _present("__v"), "__sc": F.col("__c"), "__sv": F.col("__v"), "__scv": F.col("__c") * F.col("__v"), "__svv": F.col("__v") ** 2}
    df = sliding_sums(df, sums, n, keys)
    count = F.col("__n")
    variance = F.col("__svv") / count - (F.col("__sv") / count) ** 2
    covariance = (F.col("__scv") - F.col("__sc") * F.col("__sv") / count) / (count - 1)
    kyle = F.when((count < 20) | (variance < 1e-15), 0.0).otherwise(covariance / variance)
    return df.withColumn("kyle", kyle).drop("__c", "__v", *sums)


def amihud(rows: DataFrame, n: int = 200) -> DataFrame:
    """``amihud``: mean of absolute return over volume in the last n rows with a return and a positive volume, over any distance.

    ``rows`` come in tiles.
    """
    return mean_of_newest(rows, F.when(F.col("volume") > 1e-8, F.try_divide(F.abs("ret"), F.col("volume"))), n, "amihud")


def _by_rows(df: DataFrame, keys, columns: tuple[str, ...], fill: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with double ``columns`` that ``fill`` makes from each partition's ordered rows; for statistics of sorted windows.

    A partition is handed over whole, so ``keys`` should be tiles, whose size is bounded.
    """
    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in columns)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "seq"], kind="stable")
        return rows.assign(**fill(rows))

    return df.groupBy(*keys).applyInPandas(run, schema)


def _windows(values: np.ndarray, n: int) -> np.ndarray:
    """The n values up to each one, as rows; NaN where there are fewer."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), values]), n)


def autocorrelations(df: DataFrame, n: int = 300, lags=(1, 5, 10), keys=SYMBOL) -> DataFrame:
    """``ac_k`` of the n returns before the newest: lagged products of centred returns over their number and the population variance.

    Clipped to [-1, 1]; 0 with fewer than 20 returns or no variance. The mean of the whole window is taken off both sides.
    """

    def fill(rows):
        ret = np.concatenate([[np.nan], rows["ret"].to_numpy(float)[:-1]])
        out = {f"ac_{k}": np.zeros(len(ret)) for k in lags}
        for low in range(0, len(ret), 2000):  # a bounded number of windows at a time
            w = _windows(ret[max(0, low - n + 1) : low + 2000], n)[-len(ret[low : low + 2000]) :]
            count = (~np.isnan(w)).sum(axis=1)
            mean = np.nansum(w, axis=1) / np.maximum(count, 1)
            centred = w - mean[:, None]
            variance = np.nansum(centred**2, axis=1) / np.maximum(count, 1)
            good = (count >= 20) & (variance >= 1e-18)
            for k in lags:
                product = np.nansum(centred[:, :-k] * centred[:, k:], axis=1)
                value = np.clip(product / np.maximum(count - k, 1) / np.where(good, variance, 1.0), -1, 1)
                out[f"ac_{k}"][low : low + 2000] = np.where(good, value, 0.0)
        return out

    return _by_rows(df, keys, tuple(f"ac_{k}" for k in lags), fill)


def hill_slope(df: DataFrame, n: int = 150, keys=SYMBOL) -> DataFrame:
    """``tail_slope``: 1 / max(alpha, 0.1) of the largest absolute returns in the last n.

    With m = max(5, a tenth of the returns), alpha is m over the sum of logs of the m largest against the next one.
    """

    def fill(rows):
        w = np.abs(_windows(rows["ret"].to_numpy(float), n))
        count = (~np.isnan(w)).sum(axis=1)
        top = max(5, n // 10) + 1
        largest = -np.sort(np.partition(np.where(np.isnan(w), np.inf, -w), min(top, n - 1), axis=1)[:, :top], axis=1)
        m = np.maximum(5, count // 10)
        rows_at = np.arange(len(w))
        edge = np.where(m < np.minimum(count, top), largest[rows_at, np.minimum(m, top - 1)], np.nan)
        with np.errstate(all="ignore"):
            logs = np.where(np.arange(top)[None, :] < m[:, None], np.log(largest / edge[:, None]), 0.0).sum(axis=1)
            slope = 1 / np.maximum(m / logs, 0.1)
        return {"tail_slope": np.where((count < 10) | ~(edge > 0) | ~(logs > 0), 0.0, slope)}

    return _by_rows(df, keys, ("tail_slope",), fill)


def persistence(df: DataFrame, n: int = 150, keys=SYMBOL) -> DataFrame:
    """``persistence``: products of neighbouring centred returns over their squares, in the last n; 0 without spread."""

    def fill(rows):
        ret = rows["ret"].to_numpy(float)
        out = np.zeros(len(ret))
        for low in range(0, len(ret), 2000):
            part = ret[low : low + 2000]
            w = _windows(ret[max(0, low - n + 1) : low + 2000], n)[-len(part) :]
            count = (~np.isnan(w)).sum(axis=1)
            centred = w - (np.nansum(w, axis=1) / np.maximum(count, 1))[:, None]
            square = np.nansum(centred**2, axis=1)
            good = (count > 2) & (square > 1e-20)
            out[low : low + 2000] = np.where(good, np.nansum(centred[:, :-1] * centred[:, 1:], axis=1) / np.where(good, square, 1.0), 0.0)
        return {"persistence": out}

    return _by_rows(df, keys, ("persistence",), fill)


def rolling_rank_correlation(df: DataFrame, x: str, y: str, n: int = 20, least: int = 10, keys=SYMBOL) -> DataFrame:
    """``ic_n``: rank correlation of two columns without nulls in the last n rows, ties by mean ranks; 0 with fewer than ``least``."""

    def ranks(w):
        valid = ~np.isnan(w)
        below = (w[:, None, :] < w[:, :, None]).sum(axis=2)
        equal = (w[:, None, :] == w[:, :, None]).sum(axis=2)
        return np.where(valid, below + (equal + 1) / 2, np.nan)

    def fill(rows):
        a, b = (_windows(rows[c].to_numpy(float), n) for c in (x, y))
        out = np.zeros(len(a))
        for low in range(0, len(a), 2000):
            p, q = ranks(a[low : low + 2000]), ranks(b[low : low + 2000])
            count = (~np.isnan(p)).sum(axis=1)
            p, q = (v - (np.nansum(v, axis=1) / np.maximum(count, 1))[:, None] for v in (p, q))
            spread = np.sqrt(np.nansum(p * p, axis=1) * np.nansum(q * q, axis=1))
            good = (count >= least) & (spread > 1e-12)
            out[low : low + 2000] = np.where(good, np.nansum(p * q, axis=1) / np.where(good, spread, 1.0), 0.0)
        return {f"ic_{n}": out}

    return _by_rows(df, keys, (f"ic_{n}",), fill)


def left_tail_alpha(df: DataFrame, n: int = 200, share: float = 0.1, keys=SYMBOL) -> DataFrame:
    """``alpha``: Hill's estimate from the k = max(5, share * count) lowest of the last n returns, clipped to [1, 10].

    2 where the k lowest are not all losses or are all equal.
    """

    def fill(rows):
        w = _windows(rows["ret"].to_numpy(float), n)
        count = (~np.isnan(w)).sum(axis=1)
        most = max(5, int(n * share))
        lowest = np.sort(np.partition(np.where(np.isnan(w), np.inf, w), min(most, n - 1), axis=1)[:, :most], axis=1)
        k = np.minimum(np.maximum(5, (count * share + 1e-9).astype(int)), count)
        losses = -lowest
        edge = losses[np.arange(len(w)), np.maximum(k, 1) - 1]
        with np.errstate(all="ignore"):
            logs = np.where(np.arange(most)[None, :] < k[:, None], np.log(losses / edge[:, None]), 0.0).sum(axis=1)
            alpha = np.clip(k / logs, 1.0, 10.0)
        return {"alpha": np.where((count > 0) & (edge > 0) & (logs > 0), alpha, 2.0)}

    return _by_rows(df, keys, ("alpha",), fill)


def average_true_range(df: DataFrame, bar: int = 10, n: int = 28, keys=SYMBOL) -> DataFrame:
    """``atr``: true ranges of trailing bars of 10 prices against the previous price, weighted by exp(linspace(-1, 0)) over the last 28.

    A plain mean until there are 14.
    """
    bars = last(bar, keys)
    high, low = F.max("price").over(bars), F.min("price").over(bars)
    was = F.lag("price").over(ordered(keys))
    df = df.withColumn("tr", F.when(was.isNotNull(), F.greatest(high - low, F.abs(high - was), F.abs(low - was))))
    df = df.withColumn("__t", F.collect_list("tr").over(last(n, keys)))
    size = F.size("__t")
    weights = F.transform("__t", lambda x, i: F.exp(i.cast("double") / (size - 1) - 1))
    weighted = F.aggregate(F.zip_with("__t", weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    plain = F.aggregate("__t", F.lit(0.0), lambda s, x: s + x) / size
    return df.withColumn("atr", F.when(size == 0, 0.0).when(size < 14, plain).otherwise(weighted)).drop("__t")


def evaluated(df: DataFrame, window: int = 150, every: int = 10) -> DataFrame:
    """The rows at which a window is evaluated: every tenth tick once ``window`` returns exist; adds ``k``, their number.

    ``df`` has the row number ``n`` within its symbol, as ``tiles.rolling`` gives it.
    """
    return df.where((F.col("n") > window) & (F.col("n") % every == 0)).withColumn("k", (F.col("n") / every).cast("long") - window // every)


def vol_of_vol(evaluated: DataFrame, n: int = 50, keys=SYMBOL) -> DataFrame:
    """``vol_of_vol``: population deviation of the last n sigmas on evaluation rows; 0 with fewer than 10."""
    w = last(n, keys)
    return evaluated.withColumn("vol_of_vol", F.when(F.count("sigma").over(w) < 10, 0.0).otherwise(F.stddev_pop("sigma").over(w)))


def weighted_sigma(evaluated: DataFrame, n: int = 50, keys=SYMBOL) -> DataFrame:
    """``weighted_sigma``: the last n sigmas on evaluation rows, weighted by exp(linspace(-1, 0))."""
    df = evaluated.withColumn("__s", F.collect_list("sigma").over(last(n, keys)))
    size = F.size("__s")
    weights = F.transform("__s", lambda x, i: F.exp(F.when(size > 1, i.cast("double") / (size - 1) - 1).otherwise(-1.0)))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("weighted_sigma", add(F.zip_with("__s", weights, lambda x, w: x * w)) / add(weights)).drop("__s")


def stencil(df: DataFrame, col: str = "price", keys=SYMBOL) -> DataFrame:
    """``velocity, acceleration`` of a column from its last five values, from three until there are as many, 0 before."""
    w = ordered(keys)
    x, a, b, c, d = (F.col(col), *(F.lag(col, i).over(w) for i in range(1, 5)))
    return df.withColumns(
        {
            "velocity": F.when(d.isNotNull(), (-d + 8 * c - 8 * a + x) / 12).when(b.isNotNull(), x - a).otherwise(0.0),
            "acceleration": F.when(d.isNotNull(), (-d + 16 * c - 30 * b + 16 * a - x) / 12).when(b.isNotNull(), x - 2 * a + b).otherwise(0.0),
        }
    )


def _running_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations of the first i values that are no NaN, for i from 0 on; nothing is subtracted from a sum."""
    valid = ~np.isnan(x)
    count = np.append(0, np.cumsum(valid))
    mean = np.append(0.0, np.cumsum(np.where(valid, x, 0.0))) / np.maximum(count, 1)
    n = count[1:]
    steps = np.where(valid & (n > 1), (x - mean[:-1]) ** 2 * (n - 1) / np.maximum(n, 1), 0.0)
    return count, mean, np.append(0.0, np.cumsum(steps))


def _time_window(at: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population variance of the values at most ``width`` before each place ``at``, which ascend; equal places see each other.

    Time is cut into blocks of ``width``. A window is the end of one block and the beginning of the next.
    """
    count, mean, var = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at))
    block = at // width
    edges = np.append(np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(at))
    before, was = (np.empty(0, np.int64), np.empty(0)), None
    for low, high in zip(edges[:-1], edges[1:]):
        times, values = at[low:high], x[low:high]
        old_times, old_values = before if was == block[low] - 1 else (times[:0], values[:0])
        newer = _running_moments(values)
        older = _running_moments(old_values[::-1])
        end = np.searchsorted(times, times, "right")
        held = len(old_times) - np.searchsorted(old_times, times - width, "left")
        (na, ma, sa), (nb, mb, sb) = ([p[held] for p in older], [p[end] for p in newer])
        n = na + nb
        some = np.maximum(n, 1)
        gap = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
        count[low:high] = n
        mean[low:high] = np.where(na > 0, ma + gap * nb / some, mb)
        var[low:high] = (sa + sb + gap * gap * na * nb / some) / some
        before, was = (times, values), block[low]
    return count, mean, var


def sixty_seconds(df: DataFrame, seconds: int = 60, least: int = 30, tile_windows: int = 20, key: str = "symbol", tile_rows: int = 100_000) -> DataFrame:
    """``vol_60, drift_60, intensity_60`` of the returns of the last minute by time; null with fewer than ``least``.

    Tiles are up to ``tile_windows`` blocks of time of the window's length, as many as have ``tile_rows`` rows, that
    bring the rows of the block before them; a row costs the same however many are in its window.
    """
    ship_package(df.sparkSession)
    micros = seconds * 1_000_000
    df = df.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__block", F.expr(f"div(__s - pmod(__s, {micros}), {micros})"))
    order = Window.partitionBy(key).orderBy("__block")
    blocks = df.groupBy(key, "__block").agg(F.count("*").alias("__rows"))
    sofar = F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows")
    blocks = blocks.withColumn("__own", F.struct(F.floor(F.col("__block") / tile_windows).alias("stretch"), F.floor(sofar / tile_rows).alias("part")))
    following = F.when(F.lead("__block").over(order) == F.col("__block") + 1, F.lead("__own").over(order))
    blocks = blocks.select(key, "__block", "__own", F.when(following > F.col("__own"), following).alias("__later"))
    rows = df.join(blocks, [key, "__block"]).withColumn("__tile", F.explode(F.array_compact(F.array("__own", "__later"))))
    rows = rows.select(*df.columns, "__tile", (F.col("__tile") == F.col("__own")).alias("__is_own")).drop("__block")  # a tile is ordered as time is
    kept = [f for f in rows.schema.fields if not f.name.startswith("__")]
    made = ("vol_60", "drift_60", "intensity_60")
    schema = StructType([*kept, *(StructField(c, DoubleType()) for c in made)])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("__s")
        at, ret = tile["__s"].to_numpy(), tile["ret"].to_numpy().astype(float)
        count, mean, var = _time_window(at, ret, micros)
        few = count < least
        values = (np.sqrt(var), mean, count / seconds)
        for name, value in zip(made, values):
            tile = tile.append_column(name, pa.array(value, mask=few))
        return tile.filter(tile["__is_own"]).select(schema.fieldNames())

    return rows.groupBy(key, "__tile").applyInArrow(run, schema)


def drawdown(df: DataFrame, equity: Column, keys, order) -> DataFrame:
    """``equity, peak, dd``: running peak of the equity and the fall from it as a negative share of the peak."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", equity)
    df = df.withColumn("peak", F.max("equity").over(w))
    return df.withColumn("dd", F.when(F.col("peak") > 0, (F.col("equity") - F.col("peak")) / F.col("peak")).otherwise(0.0))


def streaks(df: DataFrame, sign: Column, keys, order) -> DataFrame:
    """``sign, streak``: how many rows of one sign in a row end here."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("sign", sign).withColumn("__n", F.row_number().over(w))
    by_sign = Window.partitionBy(*keys, "sign").orderBy(*order)
    df = df.withColumn("__island", F.col("__n") - F.row_number().over(by_sign))
    return df.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "sign", "__island").orderBy(*order))).drop("__n", "__island")


def rolling_var(df: DataFrame, n: int = 200, confidence: float = 0.95, keys=SYMBOL) -> DataFrame:
    """``var, cvar`` of the last n returns: the linear-interpolated lower percentile and the mean of returns not above it; 0 with fewer than 20."""
    tail = 1 - confidence

    def fill(rows):
        w = _windows(rows["ret"].to_numpy(float), n)
        count = (~np.isnan(w)).sum(axis=1)
        most = int((n - 1) * tail) + 2
        lowest = np.sort(np.partition(np.where(np.isnan(w), np.inf, w), min(most, n - 1), axis=1)[:, :most], axis=1)
        place = np.maximum(count - 1, 0) * tail
        low = np.floor(place).astype(int)
        at = np.arange(len(w))
        a, b = lowest[at, low], lowest[at, np.minimum(low + 1, most - 1)]
        with np.errstate(all="ignore"):
            var = np.where(place > low, a + (b - a) * (place - low), a)
            inside = lowest <= var[:, None]
            cvar = np.where(inside, lowest, 0.0).sum(axis=1) / inside.sum(axis=1)
        few = count < 20
        return {"var": np.where(few, 0.0, var), "cvar": np.where(few, 0.0, cvar)}

    return _by_rows(df, keys, ("var", "cvar"), fill)
