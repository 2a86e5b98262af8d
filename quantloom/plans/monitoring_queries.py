"""Queries of monitoring, benchmarks, simulation and the joint feature table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism, materialize
from ..functions import decisions as D
from ..operators import density as N
from ..operators import entries as E
from ..operators import models as B
from ..operators import monitoring as M
from ..operators import performance as P
from ..operators import scans as S
from ..operators import trades as X
from ..operators import windows as W
from ..operators.tiles import rolling, stretched
from ..sources.views import SQL, fills, ticks, trades, with_views
from .common import ORACLE_SQL, query, r, rounded
from .density_queries import mixtures
from .model_queries import book_events
from .performance_queries import _daily
from .tick_queries import RET, O, before, lagged_returns, last

T, TR, FL = with_views("ticks"), with_views("trades"), with_views("fills")
U = f"({O} ROWS UNBOUNDED PRECEDING)"


@query(f"{T} SELECT symbol, seq, {r(f'(price - avg(price) OVER {U}) / CASE WHEN stddev_pop(price) OVER {U} > 0 THEN stddev_pop(price) OVER {U} ELSE 1 END', 'price_z')} FROM ticks")
def running_scale(spark, sf_dir):
    return rounded(M.running_scale(ticks(spark, sf_dir), ("price",)), "price_z").select("symbol", "seq", "price_z")


@query(
    f"""{RET}, v AS (SELECT symbol, seq, ts, CASE WHEN count(ret) OVER {last(20)} >= 10 THEN stddev_pop(ret) OVER {last(20)} END AS vol FROM rets
    ), q AS (SELECT symbol, seq, vol / nullif(avg(vol) OVER {last(100)}, 0) AS q FROM v), g AS (SELECT *, CASE WHEN q > 2 THEN 'CRISIS' WHEN q > 1.5 THEN 'HIGH' WHEN q > 1.1 THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_regime FROM q)
    SELECT symbol, seq, {r("q", "vol_ratio")}, risk_regime FROM g"""
)
def risk_regime(spark, sf_dir):
    return rounded(rolling(ticks(spark, sf_dir), 121, lambda d, keys: M.risk_regime(W.log_returns(d, keys), keys)), "vol_ratio").select("symbol", "seq", "vol_ratio", "risk_regime")


@query(
    f"""{T}, g AS (SELECT *, seq % 3 AS regime_id FROM ticks), d AS (SELECT symbol, seq, ts, regime_id, abs(price - first_value(price) OVER w) / greatest(CASE WHEN count(*) OVER w >= 20 THEN sqrt(var_pop(price) OVER w) ELSE 1 END, 1e-8) AS d
      FROM g WINDOW w AS (PARTITION BY symbol, regime_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
    SELECT symbol, seq, {r("avg(d) OVER (PARTITION BY symbol, regime_id ORDER BY ts, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)", "drift")} FROM d"""
)
def regime_drift(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("regime_id", F.col("seq") % 3)
    return rounded(M.drift(t, ("price",)), "drift").select("symbol", "seq", "drift")


@query(f"{RET} SELECT symbol, seq, {r(f'CASE WHEN count(ret) OVER {before(50)} = 50 THEN avg(ret) OVER {before(50)} / stddev_pop(ret) OVER {before(50)} END', 'sharpe')}, coalesce(avg(ret) OVER {last(750)} > 1e-12, false) AS rising FROM rets")
def rolling_sharpe(spark, sf_dir):
    """With the long-term trend flag."""
    out = rolling(ticks(spark, sf_dir), 751, lambda d, keys: M.long_trend(M.rolling_sharpe(W.log_returns(d, keys), keys=keys), keys=keys))
    return rounded(out, "sharpe").select("symbol", "seq", "sharpe", "rising")


@query(
    f"""{RET}, m AS (SELECT symbol, seq % 4 AS regime_id, arg_max(ret, (ts, seq)) AS mu, stddev_samp(ret) AS sigma FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, regime_id, concat_ws(' ', CASE WHEN sigma > 1e-3 THEN 'HighVol' WHEN sigma < 1e-4 THEN 'LowVol' END, 'HighEntropy', CASE WHEN mu > 1e-4 THEN 'Bullish' WHEN mu < -1e-4 THEN 'Bearish' END) AS label FROM m"""
)
def regime_labels(spark, sf_dir):
    """Words for each regime from its newest return and its deviation."""
    t = lagged_returns(spark, sf_dir).where("ret IS NOT NULL").withColumn("regime_id", F.col("seq") % 4)
    g = t.groupBy("symbol", "regime_id").agg(F.max_by("ret", F.struct("ts", "seq")).alias("mu"), F.stddev_samp("ret").alias("sigma"))
    return g.select("symbol", "regime_id", M.regime_label(F.col("mu"), F.col("sigma"), F.lit(0.0)).alias("label"))


@query(f"{TR} SELECT regime_id, count(*) AS n, {r('avg(pnl) / (stddev_samp(pnl) / sqrt(count(*)))', 't')} FROM trades GROUP BY 1")
def regime_t(spark, sf_dir):
    return rounded(M.regime_t(trades(spark, sf_dir)), "t")


@query(
    f"""{FL}, d AS (SELECT abs((price - arrival_price) / greatest(arrival_price, 1e-8)) AS y, 0.02::DOUBLE * sqrt(qty / 1000) AS x FROM fills)
    SELECT count(*) AS n, {r("sum(x * y) FILTER (y / x > 0 AND y / x < 10) / sum(x * x) FILTER (y / x > 0 AND y / x < 10)", "coefficient")}, true AS calibrated FROM d"""
)
def impact_ols(spark, sf_dir):
    f = fills(spark, sf_dir).select(((F.col("price") - F.col("arrival_price")) / F.greatest("arrival_price", F.lit(1e-8))).alias("impact"), F.lit(0.02).alias("volatility"), (F.col("qty") / 1000).alias("participation"))
    return rounded(M.impact_coefficient(f), "coefficient")


@query(
    f"""{FL} SELECT order_id, {r("sum(qty * price) / sum(qty) + 1e-9", "vwap")}, {r("sum(qty) / (sum(qty) + 5)", "fill_rate")}, CASE WHEN sum(qty) / (sum(qty) + 5) >= 0.95 THEN 'COMPLETED' WHEN sum(qty) = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status,
    {r("sum(CASE WHEN side = 'BUY' THEN (price - arrival_price) * qty ELSE (arrival_price - price) * qty END)", "shortfall")} FROM fills GROUP BY 1"""
)
def sliced_orders(spark, sf_dir):
    """Average price and completion of orders filled in slices, each asked for five more than it got (1e-9 keeps amounts in cents off ties)."""
    worse = F.when(F.col("side") == "BUY", F.col("price") - F.col("arrival_price")).otherwise(F.col("arrival_price") - F.col("price"))
    g = fills(spark, sf_dir).groupBy("order_id").agg((F.sum(F.col("qty") * F.col("price")) / F.sum("qty") + 1e-9).alias("vwap"), F.sum("qty").alias("filled"), F.sum(worse * F.col("qty")).alias("shortfall"))
    rate = F.col("filled") / (F.col("filled") + 5)
    out = g.select("order_id", "vwap", rate.alias("fill_rate"), F.when(rate >= 0.95, "COMPLETED").when(F.col("filled") == 0, "FAILED").otherwise("PARTIAL").alias("status"), "shortfall")
    return rounded(out, "vwap", "fill_rate", "shortfall")


@query(
    f"""{T}, d AS (SELECT *, price / max(price) OVER {U} - 1 AS fall FROM ticks), g AS (SELECT symbol, arg_min(price, (ts, seq)) AS first, arg_max(price, (ts, seq)) AS last, min(fall) AS dd FROM d GROUP BY 1)
    SELECT symbol, first, last, {r("dd", "max_drawdown")}, {r("last / first - 1", "ret")} FROM g"""
)
def buy_and_hold(spark, sf_dir):
    return rounded(M.buy_and_hold(ticks(spark, sf_dir)), "max_drawdown", "ret")


@query(
    f"""{TR}, g AS (SELECT regime_id, symbol % 7 = 0 AS banned, symbol % 11 <> 0 AS healthy, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS wr, sum(pnl) AS pnl, corr(hold, pnl) AS ic, avg(pnl) AS move, symbol FROM trades GROUP BY regime_id, symbol
    ), x AS (SELECT CASE WHEN banned THEN 'BANNED' WHEN NOT healthy THEN 'UNHEALTHY' WHEN n >= 10 AND (wr < 0.3 OR pnl < -50) THEN 'TOXIC' WHEN ic < 0.02 THEN 'LOW_IC' WHEN abs(move) < 2 * 5 THEN 'COST' WHEN abs(move) / 200 < 0.5 THEN 'SNR' END AS reason FROM g)
    SELECT reason, count(*) AS n FROM x GROUP BY 1"""
)
def entry_gates(spark, sf_dir):
    """Gates applied to each regime of each instrument."""
    g = trades(spark, sf_dir).groupBy("regime_id", "symbol").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.corr("hold", "pnl").alias("ic"), F.avg("pnl").alias("move"), F.sum("pnl").alias("pnl")
    )
    g = g.withColumns({"banned": F.col("symbol") % 7 == 0, "healthy": F.col("symbol") % 11 != 0, "cost": F.lit(5.0), "noise": F.lit(200.0)})
    return g.select(M.rejected(g).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""{TR}, d AS (SELECT CAST(ts AS DATE) AS day, sum(pnl) AS x FROM trades GROUP BY 1), v AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, x FROM d), c AS (SELECT count(*) AS n FROM v
    ), k AS (SELECT t.trial, v.i AS place, {P.SQL_DRAW.format(t="t.trial", i="v.i", s=5)} % n AS pick FROM v, c, (SELECT unnest(range(1000)) AS trial) t
    ), p AS (SELECT trial, place, 1e6 + sum(v.x) OVER (PARTITION BY trial ORDER BY place) AS equity FROM k JOIN v ON v.i = k.pick
    ), e AS (SELECT trial, arg_max(equity, place) AS fin, min(equity) AS low FROM p GROUP BY 1)
    SELECT count(*) AS trials, {r("avg(CASE WHEN low > 900000 THEN 1.0::DOUBLE ELSE 0 END)", "survival")}, {r("avg(fin)", "mean", 2)}, {r("quantile_cont(fin, 0.05)", "p5", 2)}, {r("quantile_cont(fin, 0.5)", "median", 2)}, {r("quantile_cont(fin, 0.95)", "p95", 2)} FROM e"""
)
def monte_carlo(spark, sf_dir):
    """A thousand equity paths of resampled days."""
    daily = _daily(spark, sf_dir)
    count = daily.agg(F.count("*").alias("n"))
    picks = daily.select(F.col("i").alias("place")).crossJoin(F.broadcast(spark.range(1000).toDF("trial"))).crossJoin(F.broadcast(count))
    picks = picks.select("trial", "place", (P.draw(F.col("trial"), F.col("place"), 5) % F.col("n")).alias("i")).join(daily, "i")
    equity = F.lit(1e6) + F.sum("x").over(Window.partitionBy("trial").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    out = M.ruin(picks.select("trial", F.col("place").alias("i"), equity.alias("equity")), 900_000.0)
    return rounded(rounded(out, "survival"), "mean", "p5", "median", "p95", digits=2)


@query(
    f"""{TR}, s AS (SELECT symbol, avg(pnl) / stddev_samp(pnl) AS b, avg(pnl - 10) / stddev_samp(pnl) AS x FROM trades GROUP BY 1)
    SELECT symbol, CASE WHEN abs(x - b) / greatest(abs(b), 1e-10) < 0.1 THEN 'robust' WHEN abs(x - b) / greatest(abs(b), 1e-10) < 0.5 THEN 'sensitive' ELSE 'unstable' END AS class, {r("-(x - 0.01)", "objective")} FROM s"""
)
def cost_sensitivity(spark, sf_dir):
    """How the ratio of profit to its deviation stands ten more units of cost on each trade."""
    s = trades(spark, sf_dir).groupBy("symbol").agg((F.avg("pnl") / F.stddev_samp("pnl")).alias("b"), (F.avg(F.col("pnl") - 10) / F.stddev_samp("pnl")).alias("x"))
    out = s.select("symbol", M.sensitivity(F.col("b"), F.col("x")).alias("class"), M.objective(F.col("x"), F.lit(0.0), F.lit(0.01), F.lit(0.0)).alias("objective"))
    return rounded(out, "objective")


FEATURES = (
    "mu", "sigma", "skew", "kurt", "tail_slope", "entropy", "ofi_sum", "vpin", "kyle", "amihud", "depth_imbalance", "toxicity", "ac_1", "ac_5", "ac_10", "mom_50", "mom_200", "mean_rev", "vol_of_vol",
    "regime_age", "confidence", "since_transition", "cluster_distance", "spread_frac", "intensity", "liquidity_pull", "pressure", "spoofing", "spread_bps", "imbalance", "velocity", "trajectory_z",
    "vpin_spread", "kyle_confidence", "amihud_vol_of_vol", "ofi_pressure", "vpin_kyle", "fat_tail",
)


def window_rows(t, tile_rows=10_000):
    """Evaluation rows of ticks with every feature of windows, books and volume buckets."""

    def features(d, keys):
        d = W.moments(W.log_returns(d, keys), keys=keys)
        d = W.flow(W.order_flow_imbalance(d, keys), keys=keys)
        d = W.kyle_lambda(W.mean_reversion(W.momentum(d, keys), keys=keys), keys=keys)
        return W.autocorrelations(W.hill_slope(d, keys=keys), keys=keys)

    # spreads and ratios are means of valid rows over any distance, which tiles carry on
    made = materialize(rolling(t, 302, features, tile_rows, keep_tile=True, tasks=default_parallelism(t.sparkSession)), "window-features")  # read more than once below
    rows = W.amihud(W.spread_stats(made))
    rows = stretched(W.evaluated(rows).drop("tile"), 49, lambda d, keys: W.vol_of_vol(d, keys=keys))
    # books: a ladder on each side of the tick, pulled and spoofed levels from the tick's own operations
    mid = (F.col("bid") + F.col("ask")) / 2
    size = F.col("bid_size") + F.col("ask_size")
    rows = rows.withColumns({
        "depth_imbalance": (F.col("bid_size") - F.col("ask_size")) / size, "imbalance": (F.col("bid_size") - F.col("ask_size")) / size, "spread_bps": (F.col("ask") - F.col("bid")) / mid * 10_000,
        "pressure": D.book_pressure(D.levels(mid, F.lit(0.01), F.col("bid_size"), -1), D.levels(mid, F.lit(0.01), F.col("ask_size"), 1)),
    })
    return rows


def with_buckets(rows, t):
    """Levels pulled and spoofed, and the newest closed volume bucket, of each row."""
    book = B.book_dynamics(book_events(t)).select("symbol", "seq", F.greatest("pull_bid", "pull_ask").alias("liquidity_pull"), "spoofing")
    rows = rows.join(book, ["symbol", "seq"], "left")
    # the newest closed volume bucket
    closed = S.toxicity(t).select("symbol", F.col("closed").alias("ts"), F.lit(0).cast("long").alias("seq"), F.col("bucket").alias("at"), "vpin")
    marks = rows.select("symbol", "ts", "seq", F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("vpin")).unionByName(closed)
    so_far = Window.partitionBy("symbol").orderBy("ts", F.col("at").asc_nulls_last(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    vpin = marks.withColumn("vpin", F.coalesce(F.last("vpin", ignorenulls=True).over(so_far), F.lit(0.0))).where("at IS NULL").select("symbol", "seq", "vpin")
    return rows.join(vpin, ["symbol", "seq"])


WINDOWED = ("mu", "sigma", "skew", "kurt", "tail_slope", "ofi_sum", "kyle", "amihud", "depth_imbalance", "toxicity", "ac_1", "ac_5", "ac_10", "mom_50", "mom_200", "mean_rev", "vol_of_vol", "spread_frac", "intensity", "pressure", "spread_bps")
SINGLE = ("vol_of_vol", "autocorr_lags", "rolling_moments", "hill_tail", "flow_toxicity", "kyle_lambda", "momentum_50_200", "price_mean_reversion")


@query(
    f"""WITH j AS (SELECT * FROM {" JOIN ".join(f"({ORACLE_SQL[name]}) {name} USING (symbol, seq)" if i else f"({ORACLE_SQL[name]}) {name}" for i, name in enumerate(SINGLE))}), {SQL["ticks"]}, p AS (
      SELECT *, abs(ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq))) / volume AS ratio FROM ticks), v AS (
      SELECT symbol, seq, bid, ask, bid_size, ask_size, avg(ratio) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 199 PRECEDING) AS a, avg(ask - bid) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 19 PRECEDING) AS s FROM p)
    SELECT symbol, seq, mu, sigma, skew, kurt, tail_slope, ofi_sum, kyle, {r("a", "amihud")}, {r("(bid_size - ask_size) / (bid_size + ask_size)", "depth_imbalance")}, toxicity, ac_1, ac_5, ac_10, mom_50, mom_200, mean_rev, vol_of_vol,
    {r("s / ((bid + ask) / 2)", "spread_frac")}, intensity, {r("(bid_size - ask_size) / (bid_size + ask_size)", "pressure")}, {r("(ask - bid) / ((bid + ask) / 2) * 10000", "spread_bps")} FROM j JOIN v USING (symbol, seq)"""
)
def window_features(spark, sf_dir):
    """The features of windows and books on evaluation rows; valid rows are all rows here, as volumes and spreads are positive."""
    return rounded(window_rows(ticks(spark, sf_dir)), *WINDOWED).select("symbol", "seq", *WINDOWED)


@query()
def feature_vector(spark, sf_dir):
    """The 38 features of each evaluation row, joined from the operators that make them; ``window_features`` has a twin for 21 of them, the tests compare others with the single queries."""
    t = ticks(spark, sf_dir)
    rows = with_buckets(window_rows(t), t)
    # densities and regimes of the same rows
    shape = N.moves(mixtures(spark, sf_dir)).select("symbol", "seq", "entropy", "velocity")
    rows = rows.join(shape, ["symbol", "seq"])
    states = ("mu", "sigma", "skew", "kurt", "tail_slope", "entropy")
    rows = rows.join(S.hmm_regimes(rows, states).select("symbol", "seq", "regime_id", "confidence"), ["symbol", "seq"])
    rows = M.drift(X.regime_changes(rows).withColumnRenamed("age", "regime_age"), ("mu", "sigma")).withColumnRenamed("drift", "cluster_distance")
    rows = M.running_scale(rows.withColumn("since_transition", F.col("regime_age") * 10), ("mu",)).withColumnRenamed("mu_z", "trajectory_z")
    return rounded(E.interactions(rows), *FEATURES).select("symbol", "seq", *FEATURES)


JOINED = " JOIN ".join(f"({ORACLE_SQL[name]}) {name} USING (symbol, seq)" if i else f"({ORACLE_SQL[name]}) {name}" for i, name in enumerate(("rolling_moments", "ofi_bbo", "ofi_zscore", "momentum_50_200", "price_mean_reversion", "book_slope", "kyle_lambda", "flow_toxicity")))


@query(f"SELECT symbol, seq, mu, sigma, skew, kurt, round(ofi, 6) AS ofi, ofi_z, mom_50, mom_200, mean_rev, slope, kyle, toxicity, intensity FROM {JOINED}")
def feature_table(spark, sf_dir):
    """All rolling features of each tick in one pass of tiles; the tests compare its columns with the single queries."""

    def features(d, keys):
        d = W.moments(W.log_returns(d, keys), keys=keys)
        d = W.ofi_zscore(W.order_flow_imbalance(d, keys), keys=keys)
        d = W.mean_reversion(W.momentum(d, keys), keys=keys)
        return W.flow(W.kyle_lambda(W.book_slope(d), keys=keys), keys=keys)

    cols = ("mu", "sigma", "skew", "kurt", "ofi", "ofi_z", "mom_50", "mom_200", "mean_rev", "slope", "kyle", "toxicity", "intensity")
    return rounded(rolling(ticks(spark, sf_dir), 202, features, tasks=default_parallelism(spark)), *cols).select("symbol", "seq", *cols)
