"""Queries over fills, trades and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import windows as W
from ..sources.views import fills, order_log, table, ticks, trades, with_views
from .common import query, r, rounded

FL, TR = with_views("fills"), with_views("trades")
SIGNED = "CASE WHEN side = 'BUY' THEN qty ELSE -qty END"


@query(f"{FL} SELECT symbol, sum({SIGNED}) AS position FROM fills GROUP BY 1 HAVING abs(sum({SIGNED})) > 1e-10")
def net_positions(spark, sf_dir):
    return R.net_positions(fills(spark, sf_dir))


@query(f"{FL} SELECT coalesce(sum({SIGNED}), 0) AS position FROM fills WHERE symbol = 7")
def net_position_of_symbol(spark, sf_dir):
    return fills(spark, sf_dir).where("symbol = 7").agg(F.coalesce(F.sum(R.signed_quantity()), F.lit(0.0)).alias("position"))


@query(
    f"""{FL}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, {r("sum(fees)", "fees", 2)}, {r("sum(qty * price)", "notional", 2)} FROM fills GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, n, fees, notional FROM d ORDER BY d.day DESC LIMIT 30"""
)
def daily_fills(spark, sf_dir):
    """Latest 30 days."""
    day = fills(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("fees").alias("fees"), F.sum(F.col("qty") * F.col("price")).alias("notional"))
    return rounded(day.orderBy(F.desc("day")).limit(30), "fees", "notional", digits=2).withColumn("day", F.col("day").cast("string"))


@query(f"{FL} SELECT {r('sum(fees)', 'fees', 2)}, count(*) AS n FROM fills")
def total_fees(spark, sf_dir):
    return rounded(fills(spark, sf_dir).agg(F.sum("fees").alias("fees"), F.count("*").alias("n")), "fees", digits=2)


@query(
    f"""{TR} SELECT entry_reason AS signal, count(*) AS n, {r("avg(pnl)", "mean", 4)}, {r("sum(pnl)", "total", 2)}, {r("avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)", "hit_rate")}
    FROM trades WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY 1"""
)
def signal_attribution(spark, sf_dir):
    t = trades(spark, sf_dir).where("ts >= TIMESTAMP_NTZ '1996-01-01'")
    out = t.groupBy(F.col("entry_reason").alias("signal")).agg(
        F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.sum("pnl").alias("total"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("hit_rate")
    )
    return rounded(rounded(rounded(out, "mean", digits=4), "total", digits=2), "hit_rate")


def _dims(dims):
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS value, sum(pnl) AS total, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(pnl) AS mean FROM trades GROUP BY {d}"""
        for d in dims
    )


@query(
    f"""{TR}, g AS ({_dims(("regime_id", "side", "entry_reason"))})
    SELECT dim, value, {r("total", "total", 2)}, n, {r("win_rate", "win_rate")}, {r("mean", "mean", 4)}, {r("total / sum(total) OVER (PARTITION BY dim)", "share")} FROM g"""
)
def pnl_by_dims(spark, sf_dir):
    out = R.attribution(trades(spark, sf_dir), ("regime_id", "side", "entry_reason"))
    return rounded(rounded(rounded(out, "total", digits=2), "mean", digits=4), "win_rate", "share")


@query(
    f"""{TR}, b AS (SELECT *, CASE WHEN hold >= 0 AND hold < 5 THEN '0-5' WHEN hold < 10 THEN '5-10' WHEN hold < 20 THEN '10-20' WHEN hold < 50 THEN '20-50' WHEN hold < 100 THEN '50-100' WHEN hold < 1000 THEN '100-1000' END AS bin FROM trades)
    SELECT bin, count(*) AS n, {r("sum(pnl)", "total", 2)}, {r("avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)", "win_rate")} FROM b WHERE bin IS NOT NULL GROUP BY 1"""
)
def holding_bins(spark, sf_dir):
    return rounded(rounded(R.holding_bins(trades(spark, sf_dir)), "total", digits=2), "win_rate")


@query(
    f"""{FL}, p AS (SELECT symbol, sum({SIGNED}) AS position, max_by(price, (ts, order_id, line, price)) AS mark FROM fills GROUP BY 1), v AS (SELECT position * mark AS value FROM p WHERE abs(position * mark) >= 0.01)
    SELECT {r("sum(CASE WHEN value > 0 THEN value ELSE 0 END)", "long", 2)}, {r("sum(CASE WHEN value < 0 THEN -value ELSE 0 END)", "short", 2)}, {r("sum(abs(value))", "gross", 2)}, {r("sum(value)", "net", 2)} FROM v"""
)
def exposure(spark, sf_dir):
    f = fills(spark, sf_dir)
    positions = f.groupBy("symbol").agg(F.sum(R.signed_quantity()).alias("position"), F.max_by("price", F.struct("ts", "order_id", "line", "price")).alias("mark"))
    return rounded(R.exposure(positions), "long", "short", "gross", "net", digits=2)


SLIP = f"""{FL}, s AS (SELECT *, CASE WHEN side = 'BUY' THEN price - arrival_price ELSE arrival_price - price END AS worse FROM fills
), b AS (SELECT *, CASE WHEN arrival_price > 0 THEN worse / arrival_price * 10000 ELSE 0 END AS bps FROM s)"""


def _report(dim):
    value = f"CAST({dim} AS VARCHAR)" if dim != "all" else "'all'"
    group = f"GROUP BY {dim}" if dim != "all" else ""
    return f"""SELECT '{dim}' AS dim, {value} AS value, count(*) AS n, {r("avg(bps)", "mean_bps")}, {r("quantile_cont(bps, 0.5)", "median_bps")}, {r("quantile_cont(bps, 0.95)", "p95_bps")},
      {r("max(bps)", "max_bps")}, {r("sum(worse * qty)", "shortfall", 2)}, {r("sum(fees)", "fees", 2)} FROM b {group}"""


@query(f"{SLIP} {' UNION ALL '.join(map(_report, ('all', 'side', 'regime_id', 'order_type')))}")
def execution_report(spark, sf_dir):
    out = R.execution_report(fills(spark, sf_dir))
    return rounded(rounded(out, "shortfall", "fees", digits=2), "mean_bps", "median_bps", "p95_bps", "max_bps")


@query(f"{SLIP} SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, {r('avg(bps)', 'mean_bps')} FROM b GROUP BY 1")
def slippage_by_hour(spark, sf_dir):
    return rounded(R.slippage(fills(spark, sf_dir)).groupBy("hour").agg(F.count("*").alias("n"), F.avg("slippage_bps").alias("mean_bps")), "mean_bps")


@query(
    f"""{FL}, s AS (SELECT sum(qty * price) AS notional, sum(fees) AS actual FROM fills), g(bps) AS (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0), (5.0), (10.0))
    SELECT bps, {r("notional", "notional", 2)}, {r("actual", "actual", 2)}, {r("notional * bps / 10000", "cost", 2)} FROM s, g"""
)
def cost_curve(spark, sf_dir):
    return rounded(R.cost_curve(fills(spark, sf_dir)), "notional", "actual", "cost", digits=2)


@query("SELECT o_orderkey AS order_id, o_orderstatus AS event_type FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def orphan_orders(spark, sf_dir):
    """Orders without any line."""
    return R.orphaned_orders(order_log(spark, sf_dir), fills(spark, sf_dir)).select("order_id", "event_type")


@query(
    f"""{with_views("fills", "order_log")} SELECT o.order_id, o.event_type, count(*) AS lines, {r("sum(qty * price)", "filled", 2)} FROM order_log o JOIN fills f USING (order_id) GROUP BY 1, 2"""
)
def order_fill_join(spark, sf_dir):
    joined = order_log(spark, sf_dir).select("order_id", "event_type").join(fills(spark, sf_dir), "order_id")
    return rounded(joined.groupBy("order_id", "event_type").agg(F.count("*").alias("lines"), F.sum(F.col("qty") * F.col("price")).alias("filled")), "filled", digits=2)


@query(
    f"""{FL}, l AS (SELECT symbol, sum({SIGNED}) AS ledger FROM fills WHERE symbol < 40 GROUP BY 1), b AS (SELECT symbol, sum({SIGNED}) AS broker FROM fills WHERE symbol >= 5 AND regime_id <> 3 GROUP BY 1)
    SELECT coalesce(l.symbol, b.symbol) AS symbol, ledger, broker, coalesce(broker, ledger) AS position, abs(coalesce(ledger, 0) - coalesce(broker, 0)) > 1e-6 AS differs FROM l FULL JOIN b ON l.symbol = b.symbol"""
)
def position_reconcile(spark, sf_dir):
    """The broker knows other symbols and lacks the fills of one regime."""
    f = fills(spark, sf_dir)
    side = lambda d: d.groupBy("symbol").agg(F.sum(R.signed_quantity()).alias("position"))
    return R.reconciled(side(f.where("symbol < 40")), side(f.where("symbol >= 5 AND regime_id <> 3")))


@query(
    """WITH t AS (SELECT user_id AS symbol, event_id AS seq, ts, event_type = 'purchase' AS is_trade,
      CASE WHEN event_type IN ('view', 'click') AND event_id % 2 = 0 THEN value - 0.01::DOUBLE END AS bid,
      CASE WHEN event_type IN ('view', 'click') AND event_id % 2 <> 0 THEN value + 0.01::DOUBLE END AS ask
      FROM events WHERE value > 0 AND event_type IN ('purchase', 'view', 'click')
    ), f AS (SELECT symbol, seq, is_trade, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
    SELECT symbol, seq, round(bid, 6) AS bid, round(ask, 6) AS ask FROM f WHERE is_trade"""
)
def asof_quote_locf(spark, sf_dir):
    """Purchases of a user as trades, the user's views and clicks as one-sided quotes."""
    from ..sources.views import quotes

    bought = table(spark, sf_dir, "events").where("value > 0 AND event_type = 'purchase'").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("seq"), "ts")
    out = R.as_of_quotes(bought, quotes(spark, sf_dir)).select("symbol", "seq", "bid", "ask")
    return out.withColumns({"bid": F.round("bid", 6), "ask": F.round("ask", 6)})


@query(
    f"""WITH RECURSIVE {FL[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, order_id, line) AS n, {SIGNED} AS s FROM fills
    ), w AS (
      SELECT symbol, n, s AS after, ts AS opened, abs(s) AS traded, -s * price AS gross, fees AS paid, s AS first, 0 AS trip, NULL::TIMESTAMP AS c_opened, NULL::TIMESTAMP AS c_closed, NULL::DOUBLE AS c_traded, NULL::DOUBLE AS c_gross, NULL::DOUBLE AS c_fees, NULL::DOUBLE AS c_first FROM o WHERE n = 1
      UNION ALL
      SELECT o.symbol, o.n, w.after + o.s,
        CASE WHEN w.after = 0 OR w.after * (w.after + o.s) < 0 THEN o.ts ELSE w.opened END,
        CASE WHEN w.after = 0 THEN abs(o.s) WHEN w.after * (w.after + o.s) < 0 THEN abs(w.after + o.s) ELSE w.traded + abs(o.s) END,
        CASE WHEN w.after = 0 THEN -o.s * o.price WHEN w.after * (w.after + o.s) < 0 THEN -(w.after + o.s) * o.price ELSE w.gross - o.s * o.price END,
        CASE WHEN w.after = 0 THEN o.fees WHEN w.after * (w.after + o.s) < 0 THEN o.fees * abs((w.after + o.s) / o.s) ELSE w.paid + o.fees END,
        CASE WHEN w.after = 0 THEN o.s WHEN w.after * (w.after + o.s) < 0 THEN w.after + o.s ELSE w.first END,
        w.trip + CASE WHEN w.after = 0 OR w.after * (w.after + o.s) < 0 THEN 1 ELSE 0 END,
        CASE WHEN w.after <> 0 AND w.after * (w.after + o.s) <= 0 THEN w.opened END,
        CASE WHEN w.after <> 0 AND w.after * (w.after + o.s) <= 0 THEN o.ts END,
        CASE WHEN w.after <> 0 AND w.after * (w.after + o.s) <= 0 THEN w.traded + abs(w.after) END,
        CASE WHEN w.after <> 0 AND w.after * (w.after + o.s) <= 0 THEN w.gross + w.after * o.price END,
        CASE WHEN w.after <> 0 AND w.after * (w.after + o.s) <= 0 THEN w.paid + o.fees * abs(w.after / o.s) END,
        CASE WHEN w.after <> 0 AND w.after * (w.after + o.s) <= 0 THEN w.first END
      FROM w JOIN o ON o.symbol = w.symbol AND o.n = w.n + 1)
    SELECT symbol, c_opened AS opened, c_closed AS closed, CASE WHEN c_first > 0 THEN 'LONG' ELSE 'SHORT' END AS side, round(c_traded / 2, 4) AS qty, {r("c_gross - c_fees", "pnl", 2)}, {r("c_fees", "fees", 2)} FROM w WHERE c_opened IS NOT NULL"""
)
def round_trips(spark, sf_dir):
    out = R.round_trips(fills(spark, sf_dir)).withColumn("qty", F.round("qty", 4))
    return rounded(out, "pnl", "fees", digits=2).select("symbol", "opened", "closed", "side", "qty", "pnl", "fees")


CURVE = f"""{with_views('ticks')}, n AS (SELECT symbol, price, CAST(floor(price / 20) AS BIGINT) % 3 AS regime, row_number() OVER w AS k, lag(CAST(floor(price / 20) AS BIGINT) % 3) OVER w AS was, lead(price, 50) OVER w AS final FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)
), e AS (SELECT * FROM n WHERE regime <> was AND final IS NOT NULL
), c AS (SELECT e.was AS from_regime, e.regime AS to_regime, b.k - e.k AS "offset", count(*) AS n, avg(abs(ln(b.price / e.price))) AS curve FROM e JOIN n b ON b.symbol = e.symbol AND b.k BETWEEN e.k + 1 AND e.k + 50 GROUP BY 1, 2, 3)"""


def _curve(spark, sf_dir):
    return R.forward_curves(ticks(spark, sf_dir).withColumn("regime_id", F.floor(F.col("price") / 20) % 3))


@query(f"""{CURVE} SELECT from_regime, to_regime, CAST("offset" AS INTEGER) AS "offset", n, {r("curve", "curve")} FROM c""")
def forward_return_curve(spark, sf_dir):
    """Moves after each kind of transition between three price regimes."""
    return rounded(_curve(spark, sf_dir), "curve")


@query(
    f"""{CURVE}, p AS (SELECT from_regime, to_regime, arg_max("offset", (curve, -"offset")) AS peak FROM c WHERE n >= 5 GROUP BY 1, 2
    ), f AS (SELECT from_regime, to_regime, regr_slope(ln(curve), "offset" - peak) AS slope, regr_r2(ln(curve), "offset" - peak) AS r2 FROM c JOIN p USING (from_regime, to_regime) WHERE "offset" >= peak AND curve > 0 GROUP BY 1, 2)
    SELECT from_regime, to_regime, {r("slope", "slope")}, {r("CASE WHEN slope < 0 THEN ln(2) / -slope END", "half_life", 3)}, {r("r2", "r2")} FROM f"""
)
def alpha_half_life(spark, sf_dir):
    """How fast the moves after each kind of transition fade."""
    return rounded(rounded(R.half_life(_curve(spark, sf_dir)), "slope", "r2"), "half_life", digits=3)


@query(
    f"""{with_views('ticks')}, n AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS slot, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS ret FROM ticks), v AS (SELECT * FROM n WHERE ret IS NOT NULL)
    SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, {r("corr(x.ret, y.ret)", "rho")} FROM v x JOIN v y ON x.slot = y.slot AND x.symbol < y.symbol GROUP BY 1, 2"""
)
def correlation_matrix(spark, sf_dir):
    t = W.log_returns(ticks(spark, sf_dir)).withColumn("slot", F.row_number().over(W.ordered())).where("ret IS NOT NULL")
    return rounded(R.correlations(t), "rho")


@query(
    """SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS notional FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2"""
)
def notional_by_nation(spark, sf_dir):
    """Order notional by the account's nation: dimension joins."""
    accounts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    log = order_log(spark, sf_dir).join(accounts, F.col("account") == F.col("c_custkey"))
    return log.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("notional"), 2).alias("notional"))
