"""Queries over ticks: scans, rolling features, quality, as-of joins, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.tiles import rolling, tiled
from ..sources.views import ticks, with_views
from .common import query, r, rounded

T = with_views("ticks")
O = "PARTITION BY symbol ORDER BY ts, seq"
RET = f"{T}, rets AS (SELECT *, ln(price / lag(price) OVER ({O})) AS ret FROM ticks)"


def last(n: int) -> str:
    return f"({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def before(n: int) -> str:
    return f"({O} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(f"{T} SELECT symbol, seq, ts, price, volume FROM ticks WHERE price BETWEEN 10 AND 50 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def tick_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive price range and a range of days, pushed to the scan."""
    t = ticks(spark, sf_dir)
    return t.where("price BETWEEN 10 AND 50 AND ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'").select("symbol", "seq", "ts", "price", "volume")


@query(f"{T} SELECT symbol, seq, ts, price FROM ticks WHERE symbol = 'click' ORDER BY ts DESC, seq DESC LIMIT 1000")
def tick_log_query_topn(spark, sf_dir):
    """Newest 1000 rows of one symbol."""
    return ticks(spark, sf_dir).where("symbol = 'click'").orderBy(F.desc("ts"), F.desc("seq")).limit(1000).select("symbol", "seq", "ts", "price")


@query(f"{T} SELECT symbol, count(*) AS n FROM ticks GROUP BY 1")
def tick_count(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))


def lagged_returns(spark, sf_dir):
    """Ticks with their log returns, tile by tile."""
    return rolling(ticks(spark, sf_dir), 1, lambda d, keys: W.log_returns(d, keys)).drop("n")


@query(f"{RET} SELECT symbol, seq, {r('ret', 'ret', 9)} FROM rets")
def log_returns(spark, sf_dir):
    return rounded(lagged_returns(spark, sf_dir), "ret", digits=9).select("symbol", "seq", "ret")


@query(
    f"""{RET}, m AS (SELECT symbol, seq, count(ret) OVER w AS n, avg(ret) OVER w AS mu, stddev_samp(ret) OVER w AS sigma,
    skewness(ret) OVER w * (count(ret) OVER w - 2) / nullif(sqrt(count(ret) OVER w::DOUBLE * (count(ret) OVER w - 1)), 0) AS skew, kurtosis_pop(ret) OVER w AS kurt
    FROM rets WINDOW w AS {last(150)})
    SELECT symbol, seq, {r("CASE WHEN n < 10 THEN 0 ELSE mu END", "mu")}, {r("CASE WHEN n < 10 THEN 0 ELSE sigma END", "sigma")},
    {r("CASE WHEN n < 10 OR sigma = 0 THEN 0 ELSE skew END", "skew")}, {r("CASE WHEN n < 10 OR sigma = 0 THEN 0 ELSE kurt END", "kurt")} FROM m"""
)
def rolling_moments(spark, sf_dir):
    """Moments of the last 150 returns, by tiles of a symbol rather than whole symbols."""
    out = rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.moments(W.log_returns(d, keys), keys=keys))
    return rounded(out, "mu", "sigma", "skew", "kurt").select("symbol", "seq", "mu", "sigma", "skew", "kurt")


@query(
    f"""{T}, m AS (SELECT symbol, seq, price, avg(price) OVER w AS a, stddev_samp(price) OVER w AS s FROM ticks WINDOW w AS {last(1000)})
    SELECT symbol, seq, {r("CASE WHEN s IS NULL THEN price WHEN s = 0 THEN 0 ELSE (price - a) / s END", "z")} FROM m"""
)
def rolling_zscore(spark, sf_dir):
    out = rolling(ticks(spark, sf_dir), 1000, lambda d, keys: W.zscore(d, keys=keys))
    return rounded(out, "z").select("symbol", "seq", "z")


@query(
    f"""{RET} SELECT symbol, seq, {r(f"CASE WHEN count(ret) OVER {before(50)} < 50 THEN 0 ELSE sum(ret) OVER {before(50)} END", "mom_50")},
    {r(f"CASE WHEN count(ret) OVER {before(200)} < 200 THEN 0 ELSE sum(ret) OVER {before(200)} END", "mom_200")} FROM rets"""
)
def momentum_50_200(spark, sf_dir):
    out = rolling(ticks(spark, sf_dir), 202, lambda d, keys: W.momentum(W.log_returns(d, keys), keys))
    return rounded(out, "mom_50", "mom_200").select("symbol", "seq", "mom_50", "mom_200")


@query(
    f"""{T} SELECT symbol, seq, {r(f"CASE WHEN count(price) OVER {last(200)} < 50 OR stddev_pop(price) OVER {last(200)} < 1e-12 THEN 0 ELSE (price - avg(price) OVER {last(200)}) / stddev_pop(price) OVER {last(200)} END", "mean_rev")} FROM ticks"""
)
def price_mean_reversion(spark, sf_dir):
    return rounded(rolling(ticks(spark, sf_dir), 200, lambda d, keys: W.mean_reversion(d, keys=keys)), "mean_rev").select("symbol", "seq", "mean_rev")


OFI = f"""{T}, lagged AS (SELECT *, coalesce(lag(bid) OVER ({O}), bid) AS wb, coalesce(lag(ask) OVER ({O}), ask) AS wa,
  coalesce(lag(bid_size) OVER ({O}), 0) AS wbs, coalesce(lag(ask_size) OVER ({O}), 0) AS was FROM ticks
), flows AS (SELECT *, (CASE WHEN bid > wb THEN bid_size WHEN bid < wb THEN -wbs ELSE bid_size - wbs END)
  - (CASE WHEN ask < wa THEN ask_size WHEN ask > wa THEN -was ELSE ask_size - was END) AS ofi FROM lagged)"""


@query(f"{OFI} SELECT symbol, seq, ofi FROM flows")
def ofi_bbo(spark, sf_dir):
    return W.order_flow_imbalance(ticks(spark, sf_dir)).select("symbol", "seq", "ofi")


@query(f"{T} SELECT symbol, seq, {r('(bid_size - ask_size) / greatest(0.01::DOUBLE, ask - bid)', 'slope')} FROM ticks")
def book_slope(spark, sf_dir):
    return rounded(W.book_slope(ticks(spark, sf_dir)), "slope").select("symbol", "seq", "slope")


@query(
    f"""{OFI}, m AS (SELECT symbol, seq, ofi, CASE WHEN count(*) OVER w < 20 THEN 1 ELSE greatest(stddev_pop(ofi) OVER w, 1e-8) END AS s FROM flows WINDOW w AS {last(200)})
    SELECT symbol, seq, {r("s", "ofi_std")}, {r("ofi / s", "ofi_z")} FROM m"""
)
def ofi_zscore(spark, sf_dir):
    out = rolling(ticks(spark, sf_dir), 201, lambda d, keys: W.ofi_zscore(W.order_flow_imbalance(d, keys), keys=keys))
    return rounded(out, "ofi_std", "ofi_z").select("symbol", "seq", "ofi_std", "ofi_z")


@query(
    f"""{OFI}, m AS (SELECT symbol, seq, sum(ofi) OVER w AS o, sum(volume) OVER w AS v, (epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 1e6::DOUBLE AS span
    FROM flows WINDOW w AS {last(150)})
    SELECT symbol, seq, {r("o", "ofi_sum")}, {r("o / greatest(v, 1)", "toxicity")}, {r("CASE WHEN span > 0 THEN v / span ELSE 0 END", "intensity")} FROM m"""
)
def flow_toxicity(spark, sf_dir):
    out = rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.flow(W.order_flow_imbalance(d, keys), keys=keys))
    return rounded(out, "ofi_sum", "toxicity", "intensity").select("symbol", "seq", "ofi_sum", "toxicity", "intensity")


@query(
    f"""{T}, v AS (SELECT *, CASE WHEN seq % 5 = 0 THEN bid - 0.005::DOUBLE ELSE ask END AS a2 FROM ticks
    ), valid AS (SELECT symbol, seq, ts, avg(a2 - bid) OVER {last(20)} AS m FROM v WHERE a2 > bid
    ), j AS (SELECT v.symbol, v.seq, last_value(m IGNORE NULLS) OVER (PARTITION BY v.symbol ORDER BY v.ts, v.seq) AS m, (bid + a2) / 2 AS mid FROM v LEFT JOIN valid USING (symbol, seq))
    SELECT symbol, seq, {r("coalesce(m, 0)", "mean_spread")}, {r("CASE WHEN mid > 0 THEN coalesce(m, 0) / mid ELSE 0 END", "spread_frac")} FROM j"""
)
def spread_stats(spark, sf_dir):
    """Every fifth quote is made crossed, so that valid rows and all rows differ."""
    t = ticks(spark, sf_dir).withColumn("ask", F.when(F.col("seq") % 5 == 0, F.col("bid") - 0.005).otherwise(F.col("ask")))
    return rounded(W.spread_stats(tiled(t)), "mean_spread", "spread_frac").select("symbol", "seq", "mean_spread", "spread_frac")


@query(
    f"""{T}, c AS (SELECT *, (bid + ask) / 2 - lag((bid + ask) / 2) OVER ({O}) AS ch, sign(price - lag(price) OVER ({O})) * volume AS sv FROM ticks
    ), m AS (SELECT symbol, seq, count(sv) OVER w AS n, var_pop(sv) OVER w AS v, covar_samp(ch, sv) OVER w AS c FROM c WINDOW w AS {last(100)})
    SELECT symbol, seq, {r("CASE WHEN n < 20 OR v < 1e-15 THEN 0 ELSE c / v END", "kyle")} FROM m"""
)
def kyle_lambda(spark, sf_dir):
    return rounded(rolling(ticks(spark, sf_dir), 102, lambda d, keys: W.kyle_lambda(d, keys=keys)), "kyle").select("symbol", "seq", "kyle")


@query(
    f"""{RET}, v AS (SELECT symbol, seq, avg(abs(ret) / volume) OVER {last(200)} AS m FROM (SELECT symbol, seq, ts, ret, volume - 1 AS volume FROM rets) WHERE volume > 1e-8 AND ret IS NOT NULL)
    SELECT symbol, seq, {r(f"coalesce(last_value(m IGNORE NULLS) OVER ({O}), 0)", "amihud", 9)} FROM rets LEFT JOIN v USING (symbol, seq)"""
)
def amihud(spark, sf_dir):
    """Volumes less one, so that some are zero."""
    t = rolling(ticks(spark, sf_dir), 1, lambda d, keys: W.log_returns(d, keys), keep_tile=True).select("symbol", "seq", "n", "tile", "ret", (F.col("volume") - 1).alias("volume"))
    return rounded(W.amihud(t), "amihud", digits=9).select("symbol", "seq", "amihud")


def _ac(k: int) -> str:
    size = f"len(l) - {k}"
    prod = f"list_dot_product(list_transform(l[1:{size}], lambda x: x - m), list_transform(l[{k + 1}:], lambda x: x - m))"
    return r(f"CASE WHEN len(l) < 20 OR v < 1e-18 THEN 0 ELSE greatest(-1, least(1, {prod} / ({size}) / v)) END", f"ac_{k}")


@query(
    f"""{RET}, w AS (SELECT symbol, seq, coalesce(list(ret) FILTER (ret IS NOT NULL) OVER w, []) AS l, avg(ret) OVER w AS m, var_pop(ret) OVER w AS v FROM rets WINDOW w AS {before(300)}
    ), e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM w)
    SELECT symbol, seq, {_ac(1)}, {_ac(5)}, {_ac(10)} FROM e WHERE n > 150 AND n % 10 = 0"""
)
def autocorr_lags(spark, sf_dir):
    """Lags 1, 5 and 10 on evaluation rows."""
    out = rolling(ticks(spark, sf_dir), 302, lambda d, keys: W.autocorrelations(W.log_returns(d, keys), keys=keys))
    return rounded(W.evaluated(out), "ac_1", "ac_5", "ac_10").select("symbol", "seq", "ac_1", "ac_5", "ac_10")


@query(
    f"""{RET}, w AS (SELECT symbol, seq, list_reverse_sort(list_transform(coalesce(list(ret) FILTER (ret IS NOT NULL) OVER w, []), lambda x: abs(x))) AS a FROM rets WINDOW w AS {last(150)}
    ), s AS (SELECT *, greatest(5, len(a) // 10) AS m FROM w
    ), h AS (SELECT *, a[m + 1] AS edge, list_sum(list_transform(a[1:m], lambda x: CASE WHEN x > 0 AND a[m + 1] > 0 THEN ln(x / a[m + 1]) END)) AS logs FROM s)
    SELECT symbol, seq, {r("CASE WHEN len(a) < 10 OR edge IS NULL OR edge <= 0 OR logs <= 0 THEN 0 ELSE 1 / greatest(m / logs, 0.1::DOUBLE) END", "tail_slope")} FROM h"""
)
def hill_tail(spark, sf_dir):
    out = rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.hill_slope(W.log_returns(d, keys), keys=keys))
    return rounded(out, "tail_slope").select("symbol", "seq", "tail_slope")


@query(
    f"""{T}, b AS (SELECT symbol, seq, ts, max(price) OVER {last(10)} AS h, min(price) OVER {last(10)} AS l, lag(price) OVER ({O}) AS p FROM ticks
    ), t AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) END AS tr FROM b
    ), c AS (SELECT symbol, seq, coalesce(list(tr) FILTER (tr IS NOT NULL) OVER {last(28)}, []) AS x FROM t
    ), w AS (SELECT *, list_transform(range(len(x)), lambda i: exp(i / (len(x) - 1)::DOUBLE - 1)) AS e FROM c)
    SELECT symbol, seq, {r("CASE WHEN len(x) = 0 THEN 0 WHEN len(x) < 14 THEN list_sum(x) / len(x) ELSE list_dot_product(x, e) / list_sum(e) END", "atr")} FROM w"""
)
def atr(spark, sf_dir):
    out = rolling(ticks(spark, sf_dir), 40, lambda d, keys: W.average_true_range(d, keys=keys))
    return rounded(out, "atr").select("symbol", "seq", "atr")


@query(
    f"""{RET}, m AS (SELECT symbol, seq, ts, CASE WHEN count(ret) OVER w < 10 THEN 0 ELSE stddev_samp(ret) OVER w END AS sigma,
    row_number() OVER ({O}) AS n FROM rets WINDOW w AS {last(150)}
    ), e AS (SELECT symbol, seq, ts, sigma FROM m WHERE n > 150 AND n % 10 = 0)
    SELECT symbol, seq, {r(f"CASE WHEN count(*) OVER {last(50)} < 10 THEN 0 ELSE stddev_pop(sigma) OVER {last(50)} END", "vol_of_vol")} FROM e"""
)
def vol_of_vol(spark, sf_dir):
    out = W.vol_of_vol(W.evaluated(rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.moments(W.log_returns(d, keys), keys=keys))))
    return rounded(out, "vol_of_vol").select("symbol", "seq", "vol_of_vol")


@query(
    f"""{RET}, m AS (SELECT symbol, seq, count(ret) OVER w AS n, stddev_pop(ret) OVER w AS v, avg(ret) OVER w AS d FROM rets
    WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 36000 SECONDS PRECEDING AND CURRENT ROW))
    SELECT symbol, seq, {r("CASE WHEN n >= 30 THEN v END", "vol_60")}, {r("CASE WHEN n >= 30 THEN d END", "drift_60")}, {r("CASE WHEN n >= 30 THEN n / 36000::DOUBLE END", "intensity_60")} FROM m"""
)
def sliding_time_window(spark, sf_dir):
    """The time window of ``sixty_seconds``, ten hours long as these ticks are minutes apart."""
    out = W.sixty_seconds(lagged_returns(spark, sf_dir), seconds=36_000)
    return rounded(out, "vol_60", "drift_60", "intensity_60").select("symbol", "seq", "vol_60", "drift_60", "intensity_60")


@query(
    f"""{RET}, v AS (SELECT symbol, seq, ret, count(ret) OVER w AS n, quantile_cont(ret, 0.05) OVER w AS q, list(ret) FILTER (ret IS NOT NULL) OVER w AS l FROM rets WINDOW w AS {last(200)})
    SELECT symbol, seq, {r("CASE WHEN n < 20 THEN 0 ELSE q END", "var")}, {r("CASE WHEN n < 20 THEN 0 ELSE list_avg(list_filter(l, lambda x: x <= q)) END", "cvar")} FROM v"""
)
def rolling_var(spark, sf_dir):
    out = rolling(ticks(spark, sf_dir), 201, lambda d, keys: W.rolling_var(W.log_returns(d, keys), keys=keys))
    return rounded(out, "var", "cvar").select("symbol", "seq", "var", "cvar")


@query(
    f"""{T}, g AS (SELECT symbol, seq, ts, sign(price - lag(price) OVER ({O})) AS s, row_number() OVER ({O}) AS n FROM ticks
    ), i AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, s ORDER BY ts, seq) AS island FROM g
    ), l AS (SELECT symbol, s, island, count(*) AS len FROM i WHERE s <> 0 GROUP BY ALL)
    SELECT symbol, max(CASE WHEN s > 0 THEN len END) AS longest_up, max(CASE WHEN s < 0 THEN len END) AS longest_down FROM l GROUP BY 1"""
)
def streaks(spark, sf_dir):
    """Longest runs of rising and falling prices."""
    from pyspark.sql import Window

    t = ticks(spark, sf_dir)
    move = F.signum(F.col("price") - F.lag("price").over(Window.partitionBy("symbol").orderBy("ts", "seq")))
    out = W.streaks(t, move, ("symbol",), ("ts", "seq"))
    return out.groupBy("symbol").agg(F.max(F.when(F.col("sign") > 0, F.col("streak"))).cast("long").alias("longest_up"), F.max(F.when(F.col("sign") < 0, F.col("streak"))).cast("long").alias("longest_down"))
