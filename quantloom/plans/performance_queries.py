"""Queries of trade performance, risk and statistical validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normal
from ..operators import performance as P
from ..operators import windows as W
from ..sources.views import fills, ticks, trades, with_views
from .common import query, r, rounded
from .tick_queries import lagged_returns

TR, TK = with_views("trades"), with_views("ticks")
ORDER = "PARTITION BY symbol ORDER BY ts, order_id, line, pnl"
START = 1_000_000.0
CURVE = f"""{TR}, c AS (SELECT *, {START}::DOUBLE + sum(pnl) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS equity FROM trades
), d AS (SELECT *, (equity - greatest({START}::DOUBLE, max(equity) OVER ({ORDER} ROWS UNBOUNDED PRECEDING))) / greatest({START}::DOUBLE, max(equity) OVER ({ORDER} ROWS UNBOUNDED PRECEDING)) AS dd FROM c)"""


@query(f"{CURVE} SELECT symbol, {r('min(dd)', 'max_drawdown')}, {r('arg_max(equity, (ts, order_id, line, pnl))', 'final_equity', 2)} FROM d GROUP BY 1")
def drawdown(spark, sf_dir):
    curve = P.equity_curve(trades(spark, sf_dir), START)
    out = curve.groupBy("symbol").agg(F.min("dd").alias("max_drawdown"), F.max_by("equity", F.struct(*P.TRADE_ORDER)).alias("final_equity"))
    return rounded(rounded(out, "max_drawdown"), "final_equity", digits=2)


PERF = ("total_pnl", "avg_win", "avg_loss", "expectancy", "worst", "edge_capture", "entropy_adjusted")
PERF6 = ("win_rate", "profit_factor", "max_drawdown", "sortino", "sharpe", "calmar", "skew", "kurt", "avg_mae", "avg_mfe")


@query(
    f"""{CURVE}, y AS (SELECT symbol, sum(pnl) / {START}::DOUBLE AS ret FROM trades GROUP BY symbol, CAST(ts AS DATE)
    ), s AS (SELECT symbol, CASE WHEN count(*) >= 2 AND stddev_samp(ret) > 1e-15 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sharpe FROM y GROUP BY 1
    ), b AS (SELECT symbol, count(*) AS trades, sum(pnl) AS total_pnl, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss,
      sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor, min(dd) AS max_drawdown, avg(pnl) / stddev_samp(pnl) FILTER (pnl < 0) AS sortino, avg(pnl) AS expectancy,
      avg(mae_pct) AS avg_mae, avg(mfe_pct) AS avg_mfe, skewness(pnl) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS skew, kurtosis_pop(pnl) AS kurt, min(pnl) AS worst, sum(pnl) / sum(abs(entry_entropy)) AS entropy_adjusted FROM d GROUP BY 1)
    SELECT symbol, trades, {", ".join(r(c, c, 2) for c in PERF if c != "edge_capture")}, {r("expectancy / avg_mfe", "edge_capture", 2)}, {", ".join(r(c, c) for c in PERF6 if c != "calmar")}, {r(f"total_pnl / {START}::DOUBLE / abs(max_drawdown)", "calmar")} FROM b JOIN s USING (symbol)"""
)
def performance_metrics(spark, sf_dir):
    out = P.performance(trades(spark, sf_dir), START)
    return rounded(rounded(out, *PERF, digits=2), *PERF6).select("symbol", "trades", *PERF, *PERF6)


def _roll(n):
    w = f"({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""{r(f"avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER {w}", f"wr_{n}")}, {r(f"sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) OVER {w} / greatest(-sum(CASE WHEN pnl > 0 THEN 0 ELSE pnl END) OVER {w}, 1e-10)", f"pf_{n}", 3)}, {r(f"avg(pnl) OVER {w} + 1e-7", f"exp_{n}", 4)}"""


@query(f"{TR} SELECT symbol, order_id, line, {r('pnl', 'pnl', 4)}, {_roll(20)}, {_roll(50)}, {_roll(100)} FROM trades WHERE symbol < 10")
def rolling_trade_metrics(spark, sf_dir):
    """Of the first ten instruments, a filter that reaches the scan."""
    out = P.rolling_trades(trades(spark, sf_dir).where("symbol < 10"))
    for n in (20, 50, 100):
        out = out.withColumn(f"exp_{n}", F.col(f"exp_{n}") + 1e-7)  # means of amounts in cents fall on ties
        out = rounded(rounded(rounded(out, f"wr_{n}"), f"pf_{n}", digits=3), f"exp_{n}", digits=4)
    return rounded(out, "pnl", digits=4).select("symbol", "order_id", "line", "pnl", *(f"{m}_{n}" for n in (20, 50, 100) for m in ("wr", "pf", "exp")))


@query(
    f"""{TR}, g AS (SELECT symbol, sign(pnl) AS s, ts, order_id, line, pnl, row_number() OVER ({ORDER}) AS n FROM trades), i AS (SELECT symbol, s, n - row_number() OVER (PARTITION BY symbol, s ORDER BY ts, order_id, line, pnl) AS k FROM g
    ), l AS (SELECT symbol, s, k, count(*) AS len FROM i GROUP BY ALL)
    SELECT symbol, coalesce(max(len) FILTER (s > 0), 0) AS wins, coalesce(max(len) FILTER (s < 0), 0) AS losses FROM l GROUP BY 1"""
)
def win_loss_streaks(spark, sf_dir):
    out = W.streaks(trades(spark, sf_dir), F.signum("pnl"), ("symbol",), P.TRADE_ORDER)
    longest = lambda s: F.coalesce(F.max(F.when(F.col("sign") == s, F.col("streak"))), F.lit(0)).cast("long")
    return out.groupBy("symbol").agg(longest(1).alias("wins"), longest(-1).alias("losses"))


RETS = f"{TK}, v AS (SELECT symbol, seq, seq % 4 AS regime_id, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS ret FROM ticks), r AS (SELECT * FROM v WHERE ret IS NOT NULL)"


def _returns(spark, sf_dir):
    return lagged_returns(spark, sf_dir).where("ret IS NOT NULL").withColumn("regime_id", F.col("seq") % 4)


@query(
    f"""{RETS}, q AS (SELECT symbol, count(*) AS n, quantile_cont(ret, 0.05) AS var FROM r GROUP BY 1)
    SELECT q.symbol, n, {r("var", "var")}, {r("avg(ret) FILTER (ret <= var)", "cvar")} FROM q JOIN r USING (symbol) GROUP BY ALL"""
)
def var_cvar(spark, sf_dir):
    return rounded(P.value_at_risk(_returns(spark, sf_dir), ("symbol",)), "var", "cvar")


@query(
    f"""{RETS}, q AS (SELECT regime_id, count(*) AS n, quantile_cont(ret, 0.05) AS var FROM r GROUP BY 1)
    SELECT regime_id, n, {r("var", "var")}, {r("avg(ret) FILTER (ret <= var)", "cvar")}, true AS own FROM q JOIN r USING (regime_id) GROUP BY ALL"""
)
def regime_var(spark, sf_dir):
    return rounded(P.regime_var(_returns(spark, sf_dir)), "var", "cvar")


Q95 = normal.sql_quantile("0.95::DOUBLE")


@query(
    f"""WITH h(hours) AS (VALUES (1.0::DOUBLE), (16.0), (64.0)), g AS (SELECT hours, 0.16::DOUBLE / sqrt(252 * 6.5::DOUBLE) * sqrt(hours) * 0.6::DOUBLE AS vol FROM h)
    SELECT hours, {r("vol", "gap_vol")}, {r(f"-{Q95} * vol", "gap_var")}, {r(f"-{Q95} * vol * 1.3::DOUBLE", "gap_cvar")} FROM g"""
)
def gap_risk(spark, sf_dir):
    """Risk of a price gap over closed hours from annual volatility of 16 %."""
    hours = spark.createDataFrame([(1.0,), (16.0,), (64.0,)], "hours double")
    vol = F.lit(0.16) / F.sqrt(F.lit(252 * 6.5)) * F.sqrt("hours") * 0.6
    z = normal.quantile(F.lit(0.05))
    return rounded(hours.select("hours", vol.alias("gap_vol"), (z * vol).alias("gap_var"), (z * vol * 1.3).alias("gap_cvar")), "gap_vol", "gap_var", "gap_cvar")


#: Fixed values: (scenario, worst day, week) returns of the stress scenarios.
SCENARIOS = [
    ("covid_crash_2020", -0.1198, -0.1453),
    ("gfc_2008", -0.0947, -0.1815),
    ("flash_crash_2010", -0.0347, -0.0637),
    ("volmageddon_2018", -0.0410, -0.0539),
    ("rate_shock", -0.0500, -0.0800),
    ("liquidity_crisis", -0.0700, -0.1000),
]


@query(
    f"""{with_views("fills")}, p AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END * price) AS value FROM fills GROUP BY 1), s(scenario, day, week) AS (VALUES {", ".join(f"('{n}', {d}::DOUBLE, {w}::DOUBLE)" for n, d, w in SCENARIOS)})
    SELECT symbol, scenario, {r("value * day", "day_pnl", 2)}, {r("value * week", "week_pnl", 2)}, abs(value * day) < abs(value) * 0.5 AS survives FROM p, s"""
)
def stress_scenarios(spark, sf_dir):
    value = F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")) * F.col("price"))
    positions = fills(spark, sf_dir).groupBy("symbol").agg(value.alias("value"))
    stressed = positions.crossJoin(F.broadcast(spark.createDataFrame(SCENARIOS, "scenario string, day double, week double")))  # six rows
    out = stressed.select("symbol", "scenario", (F.col("value") * F.col("day")).alias("day_pnl"), (F.col("value") * F.col("week")).alias("week_pnl"), (F.abs(F.col("value") * F.col("day")) < F.abs("value") * 0.5).alias("survives"))
    return rounded(out, "day_pnl", "week_pnl", digits=2)


SH = f"{TR}, s AS (SELECT symbol, avg(pnl) / stddev_samp(pnl) AS sharpe, count(*) AS n, skewness(pnl) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS skew, kurtosis_pop(pnl) AS kurt FROM trades GROUP BY 1)"
TOP = f"((1 - {P.EULER_GAMMA}::DOUBLE) * {normal.sql_quantile('(1 - 1 / 50::DOUBLE)')} + {P.EULER_GAMMA}::DOUBLE * {normal.sql_quantile('(1 - 1 / (50 * exp(1)))')})"


def _sharpes(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("symbol").agg(
        (F.avg("pnl") / F.stddev_samp("pnl")).alias("sharpe"), F.count("*").alias("n"), F.skewness("pnl").alias("skew"), F.kurtosis("pnl").alias("kurt")
    )


@query(
    f"""{SH}, d AS (SELECT *, {TOP} AS expected_max, (sharpe - {TOP}) / greatest(sqrt(greatest(0, 1 - skew * sharpe + kurt / 4 * sharpe * sharpe) / greatest(n - 1, 1)), 1e-10) AS dsr FROM s)
    SELECT symbol, n, {r("sharpe", "sharpe")}, {r("expected_max", "expected_max")}, {r("dsr", "dsr", 4)}, {r(f"1 - {normal.sql_cumulative('dsr')}", "p_value")} FROM d"""
)
def deflated_sharpe(spark, sf_dir):
    """Each instrument's ratio as the best of fifty trials."""
    out = P.deflated_sharpe(_sharpes(spark, sf_dir).withColumn("trials", F.lit(50)), "sharpe", "trials", "n", "skew", "kurt")
    return rounded(rounded(out, "sharpe", "expected_max", "p_value"), "dsr", digits=4).select("symbol", "n", "sharpe", "expected_max", "dsr", "p_value")


@query(f"{SH}, z AS (SELECT symbol, sharpe / sqrt((1 - skew * sharpe + kurt / 4 * sharpe * sharpe) / greatest(n - 1, 1)) AS z FROM s) SELECT symbol, {r(normal.sql_cumulative('z'), 'psr')} FROM z")
def probabilistic_sharpe(spark, sf_dir):
    out = _sharpes(spark, sf_dir).select("symbol", P.probabilistic_sharpe(F.col("sharpe"), F.lit(0.0), F.col("n"), F.col("skew"), F.col("kurt")).alias("psr"))
    return rounded(out, "psr")


PV = f"{TR}, g AS (SELECT symbol, avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))) AS z FROM trades GROUP BY 1), t AS (SELECT symbol, 2 * (1 - {normal.sql_cumulative('abs(z)')}) AS p_value FROM g)"


def _p_values(spark, sf_dir):
    g = trades(spark, sf_dir).groupBy("symbol").agg((F.avg("pnl") / (F.stddev_samp("pnl") / F.sqrt(F.count("*")))).alias("z"))
    return g.select("symbol", (2 * (1 - normal.cumulative(F.abs("z")))).alias("p_value"))


@query(f"{PV} SELECT symbol, {r('p_value', 'p_value')}, p_value < 0.05 / count(*) OVER () AS significant FROM t")
def bonferroni(spark, sf_dir):
    return rounded(P.bonferroni(_p_values(spark, sf_dir)), "p_value").select("symbol", "p_value", "significant")


@query(
    f"""{PV}, k AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM t), c AS (SELECT max(p_value) AS cut FROM k WHERE p_value <= 0.3 * k / m)
    SELECT symbol, {r("p_value", "p_value")}, coalesce(p_value <= cut, false) AS rejected FROM t, c"""
)
def false_discovery_rate(spark, sf_dir):
    return rounded(P.false_discovery(_p_values(spark, sf_dir), alpha=0.3), "p_value")


@query(
    f"""{TR}, i AS (SELECT symbol, abs(pnl) AS x, row_number() OVER (PARTITION BY symbol ORDER BY abs(pnl)) AS i FROM trades)
    SELECT symbol, {r("(2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x))", "gini")} FROM i GROUP BY 1"""
)
def pnl_gini(spark, sf_dir):
    return rounded(P.gini(trades(spark, sf_dir), "pnl", ("symbol",)), "gini")


@query(
    f"""{TR}, b AS (SELECT symbol % 10 AS trial, CAST(order_id // 4 % 16 AS INTEGER) AS block, count(*) AS n, sum(pnl) AS s, sum(pnl * pnl) AS q FROM trades GROUP BY 1, 2
    ), sp AS (SELECT m FROM range(65536) t(m) WHERE bit_count(m) = 8
    ), sd AS (SELECT m, trial, (m >> block) & 1 = 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM b, sp GROUP BY ALL
    ), sh AS (SELECT *, (s / n) / sqrt((q - n * (s / n) * (s / n)) / (n - 1)) AS sharpe FROM sd
    ), best AS (SELECT m, arg_max(trial, (sharpe, -trial)) AS trial FROM sh WHERE inside GROUP BY ALL
    ), o AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY sharpe, trial) - 1 AS k, count(*) OVER (PARTITION BY m) AS c FROM sh WHERE NOT inside
    ), l AS (SELECT least(0.99::DOUBLE, greatest(0.01::DOUBLE, k / (c - 1)::DOUBLE)) AS p FROM o JOIN best USING (m, trial))
    SELECT count(*) AS splits, {r("avg(CASE WHEN ln(p / (1 - p)) < 0 THEN 1.0::DOUBLE ELSE 0 END)", "pbo")}, {r("avg(ln(p / (1 - p)))", "mean_logit")} FROM l"""
)
def cscv_pbo(spark, sf_dir):
    """Ten groups of instruments as trials, sixteen blocks of orders: 12870 splits."""
    t = trades(spark, sf_dir).select((F.col("symbol") % 10).alias("trial"), (F.floor(F.col("order_id") / 4) % 16).cast("int").alias("block"), F.col("pnl").alias("ret"))
    return rounded(P.combinatorial_overfit(t, blocks=16), "pbo", "mean_logit")


NUM = f"{TR}, d AS (SELECT CAST(ts AS DATE) AS day, sum(pnl) AS x FROM trades GROUP BY 1), v AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, x FROM d)"


def _daily(spark, sf_dir):
    """Daily profit, numbered: as many rows as days."""
    day = trades(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("x"))
    return day.select((F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("i"), "x")


@query(
    f"""{NUM}, c AS (SELECT count(*) AS n FROM v), k AS (SELECT t.trial, {P.SQL_DRAW.format(t="t.trial", i="v.i", s=42)} % n AS i FROM v, c, (SELECT unnest(range(5000)) AS trial) t
    ), m AS (SELECT trial, avg(x) AS mean FROM k JOIN v USING (i) GROUP BY 1)
    SELECT {r("avg(mean)", "mean", 3)}, {r("quantile_cont(mean, 0.025)", "low", 3)}, {r("quantile_cont(mean, 0.975)", "high", 3)} FROM m"""
)
def bootstrap_ci(spark, sf_dir):
    """Confidence interval of mean daily profit from 5000 samples."""
    means = P.bootstrap(_daily(spark, sf_dir), 5000)
    out = means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return rounded(out, "mean", "low", "high", digits=3)


@query(
    f"""{NUM}, o AS (SELECT abs(avg(x)) AS seen FROM v), m AS (SELECT t.trial, avg(CASE WHEN {P.SQL_DRAW.format(t="t.trial", i="v.i", s=7)} % 2 = 0 THEN x ELSE -x END) AS mean FROM v, (SELECT unnest(range(5000)) AS trial) t GROUP BY 1)
    SELECT {r("any_value(seen)", "seen", 3)}, {r("avg(CASE WHEN abs(mean) >= seen THEN 1.0::DOUBLE ELSE 0 END)", "p_value")} FROM m, o"""
)
def permutation_test(spark, sf_dir):
    """Two-sided sign-flip test of mean daily profit."""
    daily = _daily(spark, sf_dir)
    seen = daily.agg(F.abs(F.avg("x")).alias("seen"))
    means = P.sign_flips(daily, 5000).crossJoin(F.broadcast(seen))  # one row
    out = means.agg(F.first("seen").alias("seen"), F.avg(F.when(F.abs("mean") >= F.col("seen"), 1.0).otherwise(0.0)).alias("p_value"))
    return rounded(rounded(out, "seen", digits=3), "p_value")


@query(
    f"""{TK}, t AS (SELECT count(*) AS total FROM ticks), f AS (SELECT unnest(range(5)) AS fold), c AS (SELECT CAST(fold AS INTEGER) AS fold, total, floor(total * (0.5::DOUBLE + fold * 0.1::DOUBLE))::BIGINT AS cut, CASE WHEN fold = 4 THEN total ELSE floor(total * (0.5::DOUBLE + (fold + 1) * 0.1::DOUBLE))::BIGINT END AS e FROM t, f)
    SELECT fold, 'train' AS part, 1::BIGINT AS "first", cut AS "last", cut AS n FROM c UNION ALL SELECT fold, 'test', cut + 1, e, e - cut FROM c"""
)
def walk_forward_folds(spark, sf_dir):
    rows = ticks(spark, sf_dir).agg(F.count("*").alias("n"))
    return P.walk_forward_folds(rows)


@query(f"{TR} SELECT regime_id, count(*) AS n, {r('(2 + sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END)) / (4 + count(*))::DOUBLE', 'win_rate')}, {r('avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0)', 'payoff')}, {r('''greatest(0.1::DOUBLE, least(1.0::DOUBLE, (2 + sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END)) / (4 + count(*))::DOUBLE - (1 - (2 + sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END)) / (4 + count(*))::DOUBLE) / (avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0))))''', 'kelly')} FROM trades GROUP BY 1")
def bayesian_kelly(spark, sf_dir):
    """Kelly fraction of each regime from a beta posterior of its win rate."""
    won = F.sum(F.when(F.col("pnl") > 0, 1).otherwise(0))
    g = trades(spark, sf_dir).groupBy("regime_id").agg(
        F.count("*").alias("n"), ((2 + won) / (4 + F.count("*"))).alias("win_rate"), (F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))) / -F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))).alias("payoff")
    )
    kelly = F.col("win_rate") - (1 - F.col("win_rate")) / F.col("payoff")
    return rounded(g.withColumn("kelly", F.greatest(F.lit(0.1), F.least(F.lit(1.0), kelly))), "win_rate", "payoff", "kelly")
