"""Queries of the way into and out of a position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import entries as E
from ..operators import monitoring as M
from ..operators import scans as S
from ..operators import windows as W
from ..operators.tiles import numbered, rolling
from ..sources.views import ticks, trades, with_views
from .common import query, r, rounded
from .tick_queries import OFI, RET, O, before, last

T, TR = with_views("ticks"), with_views("trades")
REGIME = "CAST(floor(price / 20) AS BIGINT) % 3"


def _regime():
    return F.floor(F.col("price") / 20) % 3


@query(
    f"""{RET}, g AS (SELECT symbol, ts, seq, {REGIME} AS regime, CASE WHEN count(ret) OVER {last(20)} >= 10 THEN stddev_pop(ret) OVER {last(20)} ELSE 0 END AS sigma FROM rets
    ), c AS (SELECT symbol, sigma, regime <> lag(regime) OVER ({O}) AS transition, seq % 7 <> 0 AS risk_ok FROM g
    ), x AS (SELECT symbol, CASE WHEN NOT coalesce(transition, false) THEN 'NO_TRANSITION' WHEN NOT risk_ok THEN 'RISK' WHEN sigma <= 0 THEN 'INVALID_STATE' END AS reason FROM c)
    SELECT symbol, reason, count(*) AS n FROM x GROUP BY ALL"""
)
def eligibility(spark, sf_dir):
    """Why ticks are not looked at for an entry; risk is taken as refused on every seventh."""

    def features(d, keys):
        d = W.sliding_moments(W.log_returns(d, keys), "ret", 20, keys).withColumn("regime", _regime())
        return d.withColumn("transition", F.col("regime") != F.lag("regime").over(W.ordered(keys)))

    d = rolling(ticks(spark, sf_dir), 21, features)
    sigma = F.when(F.col("__n") >= 10, F.sqrt("__m2")).otherwise(0.0)
    return d.select("symbol", E.ineligible(F.col("transition"), F.col("seq") % 7 != 0, sigma, F.lit(0.0)).alias("reason")).groupBy("symbol", "reason").agg(F.count("*").alias("n"))


SIGNALS = f"""{OFI}, f AS (SELECT symbol, seq, ts, price, ofi, row_number() OVER ({O}) AS n, CASE WHEN count(*) OVER {last(200)} < 20 THEN 1 ELSE greatest(stddev_pop(ofi) OVER {last(200)}, 1e-8) END AS s,
  ln(price / lag(price) OVER ({O})) AS ret, (bid_size - ask_size) / (bid_size + ask_size) AS imbalance,
  CASE WHEN stddev_pop(price) OVER {last(200)} < 1e-12 OR count(price) OVER {last(200)} < 50 THEN 0 ELSE (price - avg(price) OVER {last(200)}) / stddev_pop(price) OVER {last(200)} END AS mean_rev FROM flows
), i AS (SELECT symbol, seq, ts, price, n, ofi / s AS ofi_z, greatest(-1, least(1, ofi / s * 0.3::DOUBLE)) AS order_flow, CASE WHEN count(ret) OVER {before(50)} < 50 THEN 0 ELSE sum(ret) OVER {before(50)} END AS momentum,
  -mean_rev * 0.1::DOUBLE AS reversion, greatest(-1, least(1, imbalance)) AS orderbook FROM f)"""


def _signals(spark, sf_dir):
    def features(d, keys):
        d = W.ofi_zscore(W.order_flow_imbalance(W.log_returns(d, keys), keys), keys=keys)
        return W.mean_reversion(W.momentum(d, keys), keys=keys)

    d = rolling(ticks(spark, sf_dir), 202, features)
    d = d.withColumn("imbalance", (F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size"))).withColumn("pressure", F.col("imbalance"))
    return E.composite_inputs(d)


@query(f"{SIGNALS} SELECT symbol, seq, {r('order_flow', 'order_flow')}, {r('momentum', 'momentum')}, {r('reversion', 'reversion')}, {r('orderbook', 'orderbook')} FROM i")
def composite_inputs(spark, sf_dir):
    cols = ("order_flow", "momentum", "reversion", "orderbook")
    return rounded(_signals(spark, sf_dir), *cols).select("symbol", "seq", *cols)


DIRECTION = f"""{SIGNALS}, d AS (SELECT *, round(ofi_z, 9) AS z, round(greatest(-1, least(1, (order_flow + momentum + reversion + orderbook) / 4 + 1e-12)), 9) AS direction FROM i
), a AS (SELECT *, abs(z) > 2 AND n >= 50 AS extreme, CASE WHEN (order_flow > 0) = (direction > 0) AND abs(order_flow) > 0.001 THEN 1 ELSE 0 END + CASE WHEN (momentum > 0) = (direction > 0) AND abs(momentum) > 0.001 THEN 1 ELSE 0 END
  + CASE WHEN (reversion > 0) = (direction > 0) AND abs(reversion) > 0.001 THEN 1 ELSE 0 END + CASE WHEN (orderbook > 0) = (direction > 0) AND abs(orderbook) > 0.001 THEN 1 ELSE 0 END AS agreeing FROM d
), b AS (SELECT *, NOT extreme AND abs(direction) > 0.20 AND agreeing >= 2 AS shared FROM a
), x AS (SELECT symbol, seq, ts, price, CASE WHEN extreme THEN CASE WHEN z > 0 THEN 'SELL' ELSE 'BUY' END WHEN shared THEN CASE WHEN direction > 0 THEN 'BUY' ELSE 'SELL' END END AS action,
  CASE WHEN extreme THEN 'ORDER_FLOW' WHEN shared THEN 'COMPOSITE' END AS reason, CASE WHEN extreme THEN least(1, abs(z) / 3) WHEN shared THEN abs(direction) END AS strength FROM b)"""


def _direction(spark, sf_dir):
    """``symbol, seq, ts, price, action, reason, strength``; nine digits keep rounding from deciding at the thresholds."""
    channels = ("order_flow", "momentum", "reversion", "orderbook")
    d = _signals(spark, sf_dir)
    mean = sum((F.col(c) for c in channels), F.lit(0.0)) / 4 + 1e-12
    # a generator keeps each step from being written out again in the next
    known = F.struct(F.round("ofi_z", 9).alias("z"), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)), 9).alias("direction"), *channels)
    d = d.select("symbol", "seq", "ts", "price", "n", F.inline(F.array(known)))
    rule = E.direction_rule(F.col("z"), F.col("n"), F.col("direction"), [F.col(c) for c in channels])
    none = F.struct(F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("strength"))
    return d.select("symbol", "seq", "ts", "price", F.inline(F.array(F.coalesce(rule, none))))


@query(f"{DIRECTION} SELECT symbol, action, reason, count(*) AS n, {r('avg(strength)', 'strength')} FROM x WHERE action IS NOT NULL GROUP BY ALL")
def direction_rule(spark, sf_dir):
    """Which way the order flow or the composite of four signals says to go."""
    d = _direction(spark, sf_dir).where("action IS NOT NULL")
    return rounded(d.groupBy("symbol", "action", "reason").agg(F.count("*").alias("n"), F.avg("strength").alias("strength")), "strength")


@query(
    f"""{DIRECTION}, g AS (SELECT symbol, action, {REGIME} AS regime, lead({REGIME}, 1) OVER ({O}) AS a, lead({REGIME}, 2) OVER ({O}) AS b, lead({REGIME}, 3) OVER ({O}) AS c FROM x
    ), o AS (SELECT symbol, CASE WHEN coalesce(a <> regime, false) OR coalesce(b <> regime, false) OR coalesce(c <> regime, false) THEN 'ABORTED' WHEN c IS NOT NULL THEN 'CONFIRMED' ELSE 'PENDING' END AS outcome FROM g WHERE action IS NOT NULL)
    SELECT symbol, outcome, count(*) AS n FROM o GROUP BY 1, 2"""
)
def signal_confirmation(spark, sf_dir):
    """Signals whose regime holds for three ticks."""
    d = _direction(spark, sf_dir).withColumn("regime_id", _regime())
    return E.confirmed(d, "action", 3).where("outcome IS NOT NULL").groupBy("symbol", "outcome").agg(F.count("*").alias("n"))


@query(
    f"""{RET}, v AS (SELECT symbol, seq, ts, ret AS velocity, ret - lag(ret) OVER ({O}) AS acceleration, abs(ret) * 0.1::DOUBLE AS divergence, volume - lag(volume) OVER ({O}) AS entropy_velocity, seq % 2 = 0 AS buy FROM rets
    ), f AS (SELECT *, CASE WHEN divergence < 0.001 THEN 'COLLAPSED' WHEN CASE WHEN buy THEN velocity < 0 AND acceleration < 0 ELSE velocity > 0 AND acceleration > 0 END THEN 'REACCELERATED' END AS first FROM v
    ), j AS (SELECT *, CASE WHEN entropy_velocity > 0 THEN 0 ELSE 1 END AS calm FROM f WHERE first IS NULL), k AS (SELECT *, sum(calm) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM j
    ), s AS (SELECT symbol, sum(1 - calm) OVER (PARTITION BY symbol, run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS streak FROM k
    ), d AS (SELECT symbol, first AS decay FROM f WHERE first IS NOT NULL UNION ALL SELECT symbol, CASE WHEN streak >= 2 THEN 'ENTROPY_RISES' END FROM s)
    SELECT symbol, decay, count(*) AS n FROM d GROUP BY 1, 2"""
)
def edge_decay(spark, sf_dir):
    """Why the edge of a position would be gone at each tick; volumes stand for the entropy."""

    def moves(d, keys):
        w = W.ordered(keys)
        d = W.log_returns(d, keys).withColumns({"velocity": F.col("ret"), "divergence": F.abs("ret") * 0.1, "entropy_velocity": F.col("volume") - F.lag("volume").over(w)})
        return d.withColumn("acceleration", F.col("ret") - F.lag("ret").over(w))

    d = rolling(ticks(spark, sf_dir), 2, moves).drop("n")
    d = d.withColumns({"side": F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL")})
    return E.edge_decay(d, 0.001).groupBy("symbol", "decay").agg(F.count("*").alias("n"))


@query(
    f"""{T}, m AS (SELECT symbol, price, seq, row_number() OVER ({O}) AS k FROM ticks), p AS (SELECT e.symbol, e.k AS ek, e.seq % 2 = 0 AS buy, m.k, 1 + e.seq % 9 AS qty, e.price AS p0, CASE WHEN e.seq % 2 = 0 THEN m.price / e.price - 1 ELSE 1 - m.price / e.price END AS ret
      FROM m e JOIN m ON m.symbol = e.symbol AND m.k BETWEEN e.k + 1 AND e.k + 20
    ), x AS (SELECT *, CASE WHEN ret < 0 AND abs(ret) * p0 * qty >= greatest(5, p0 * qty * 0.5 * 2) AND ret > -0.5 THEN 'MONEY_STOP' WHEN ret <= -0.5 AND ret > -0.5 * 2 THEN 'TICK_STOP' WHEN ret <= -0.5 OR (ret < 0 AND abs(ret) * p0 * qty >= greatest(5, p0 * qty * 0.5 * 2)) THEN 'HARD_STOP' END AS reason,
      least(0, min(ret) OVER w) AS mae, greatest(0, max(ret) OVER w) AS mfe FROM p WINDOW w AS (PARTITION BY symbol, ek ORDER BY k ROWS UNBOUNDED PRECEDING)
    ), f AS (SELECT symbol, ek, min(k) - ek AS after, arg_min(reason, k) AS reason, arg_min(mae, k) AS mae, arg_min(mfe, k) AS mfe FROM x WHERE reason IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, reason, count(*) AS n, {r("avg(after)", "after")}, {r("avg(mae)", "mae")}, {r("avg(mfe)", "mfe")} FROM f GROUP BY 1, 2"""
)
def tick_stops(spark, sf_dir):
    """Stops of an entry at every tick, at half its price, within 20 ticks."""
    marks = numbered(ticks(spark, sf_dir), into="k")
    entered = marks.withColumns({"side": F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL"), "qty": (1 + F.col("seq") % 9).cast("double"), "stop": F.lit(0.5)})
    out = E.tick_stops(entered, marks, 20)
    return rounded(out.groupBy("symbol", "reason").agg(F.count("*").alias("n"), F.avg(F.col("stop_k") - F.col("k")).alias("after"), F.avg("mae").alias("mae"), F.avg("mfe").alias("mfe")), "after", "mae", "mfe")


@query(
    f"""{T}, a AS (SELECT symbol, seq, (seq % 5 - 2)::DOUBLE AS held, CASE WHEN seq % 3 = 0 THEN 'BUY' WHEN seq % 3 = 1 THEN 'SELL' END AS action, volume / 3 * CASE WHEN seq % 2 = 0 THEN 1 ELSE 0.5::DOUBLE END AS qty, seq % 4 = 0 AS live FROM ticks
    ), d AS (SELECT *, CASE WHEN action IS NULL THEN 'NONE' WHEN (held > 0 AND action = 'BUY') OR (held < 0 AND action = 'SELL') THEN 'KEEP' WHEN held <> 0 THEN 'REVERSE' ELSE 'OPEN' END AS decision FROM a)
    SELECT symbol, decision, count(*) AS n, {r("sum(CASE WHEN decision = 'REVERSE' THEN abs(held) ELSE 0 END)", "closed")},
    {r("sum(CASE WHEN decision IN ('REVERSE', 'OPEN') THEN CASE WHEN live THEN greatest(1, round_even(qty, 0)) ELSE greatest(0.1::DOUBLE, qty) END ELSE 0 END)", "opened")} FROM d GROUP BY 1, 2"""
)
def entry_orders(spark, sf_dir):
    """What signals make of positions held: kept, reversed or opened, halved where the impact is not calibrated."""
    action = F.when(F.col("seq") % 3 == 0, "BUY").when(F.col("seq") % 3 == 1, "SELL")
    order = E.entry_order((F.col("seq") % 5 - 2).cast("double"), action, F.col("volume") / 3, F.col("seq") % 2 == 0, F.col("seq") % 4 == 0)
    out = ticks(spark, sf_dir).select("symbol", order.alias("o")).groupBy("symbol", "o.decision").agg(F.count("*").alias("n"), F.sum("o.close_qty").alias("closed"), F.sum("o.qty").alias("opened"))
    return rounded(out, "closed", "opened")


@query(
    f"""{RET}, m AS (SELECT symbol, seq, ret, least(1, abs(ret)) AS st, volume / 10 AS tail, CASE WHEN seq % 3 <> 0 THEN volume END AS dwell, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret IS NOT NULL THEN 0 END) OVER {last(150)} AS wr FROM rets
    ), k AS (SELECT *, greatest(0.1::DOUBLE, least(2, greatest(0, least(1, wr - (1 - wr) / 1.5::DOUBLE)) * 0.5 * 10)) AS share FROM m WHERE ret IS NOT NULL)
    SELECT symbol, seq, {r("greatest(0, least(3, share * st / greatest(0.5, tail / 2) * CASE WHEN dwell IS NULL THEN 0.5 + st * 0.5 ELSE ln(1 + dwell / 50) END))", "size")} FROM k"""
)
def legacy_sizes(spark, sf_dir):
    """Sizes without an equity."""

    def features(d, keys):
        d = W.log_returns(d, keys)
        won = F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)
        return W.sliding_sums(d, {"won": won, "seen": F.when(F.col("ret").isNotNull(), 1.0)}, 150, keys)

    d = rolling(ticks(spark, sf_dir), 151, features).where("ret IS NOT NULL")
    kelly = D.kelly(F.col("won") / F.col("seen"), F.lit(1.5))
    size = E.legacy_size(F.least(F.lit(1.0), F.abs("ret")), F.col("volume") / 10, kelly, F.when(F.col("seq") % 3 != 0, F.col("volume")))
    return rounded(d.select("symbol", "seq", size.alias("size")), "size")


@query()
def bootstrap_transitions(spark, sf_dir):
    """Transitions made up from the velocity of the mean return while flat; compared with plain Python in the tests."""
    rows = W.evaluated(rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.moments(W.log_returns(d, keys), keys=keys)))
    velocity = S.kalman_derivatives(rows.withColumn("price", F.col("mu"))).select("symbol", "seq", "velocity")
    rows = rows.join(velocity, ["symbol", "seq"])
    strength = E.bootstrapped(F.col("velocity"), F.col("sigma") / 1000, F.lit(0), F.col("seq") % 2 == 0, F.col("k"))
    return rounded(rows.select("symbol", "seq", "velocity", "sigma", "k", strength.alias("strength")), "velocity", "sigma", "strength")


@query(
    f"""WITH RECURSIVE {TR[5:]}, b AS (SELECT symbol, pnl, row_number() OVER w AS n, max(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER w AS any_win FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, order_id, line, pnl)
    ), l AS (SELECT *, n - coalesce(max(CASE WHEN pnl > 0 THEN n END) OVER (PARTITION BY symbol ORDER BY n), 0) AS losses, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER r AS win_rate,
      sum(greatest(pnl, 0)) OVER r / greatest(-sum(least(pnl, 0)) OVER r, 1e-10) AS factor FROM b WINDOW r AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
    ), m AS (
      SELECT symbol, n, losses, win_rate, factor, CASE WHEN losses >= 3 THEN greatest(0.25::DOUBLE, 1 - losses * 0.15::DOUBLE) ELSE 1.0::DOUBLE END AS mult FROM l WHERE n = 1
      UNION ALL
      SELECT l.symbol, l.n, l.losses, l.win_rate, l.factor, CASE WHEN l.losses >= 3 THEN greatest(0.25::DOUBLE, 1 - l.losses * 0.15::DOUBLE) WHEN l.win_rate > 0.3 AND l.factor > 0.5 THEN least(1.0::DOUBLE, m.mult + 0.1::DOUBLE) ELSE m.mult END FROM m JOIN l ON l.symbol = m.symbol AND l.n = m.n + 1)
    SELECT symbol, count(*) AS n, max(losses) AS most_losses, count(*) FILTER (least(n, 50) >= 10 AND win_rate < 0.1 AND factor < 0.05) AS paused, {r("min(mult)", "least_multiplier")}, {r("avg(mult)", "mean_multiplier")} FROM m GROUP BY 1"""
)
def journal_multipliers(spark, sf_dir):
    """How the journal of each symbol's trades scales sizes."""
    out = E.journal(trades(spark, sf_dir)).groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("losses").alias("most_losses"), F.count(F.when(F.col("pause"), 1)).alias("paused"), F.min("multiplier").alias("least_multiplier"), F.avg("multiplier").alias("mean_multiplier")
    )
    return rounded(out, "least_multiplier", "mean_multiplier")


@query(
    f"""{TR}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol, regime_id ORDER BY ts DESC, order_id DESC, line DESC, pnl DESC) AS back FROM trades
    ), g AS (SELECT symbol, regime_id, count(*) AS n, sum(pnl) AS total, avg(CASE WHEN back <= 10 THEN CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END END) AS wr, avg(CASE WHEN back <= 10 THEN pnl END) AS mean FROM b GROUP BY 1, 2)
    SELECT symbol, regime_id, n, {r("total", "total", 2)}, CASE WHEN total < -20000 THEN 'LOST_AT_ONCE' WHEN n < 2 THEN NULL WHEN total < -10000 THEN 'LOST' WHEN wr < 0.5 AND mean < 0 THEN 'UNPROFITABLE' END AS reason FROM g"""
)
def skipped_regimes(spark, sf_dir):
    """Regimes of each symbol that its journal leaves out."""
    return rounded(E.skipped_regimes(trades(spark, sf_dir), lost_at_once=-20_000.0, lost=-10_000.0), "total", digits=2)


@query(
    f"""{T}, v AS (SELECT symbol, seq, price, lag(price, 1) OVER ({O}) AS a, lag(price, 2) OVER ({O}) AS b, lag(price, 3) OVER ({O}) AS c, lag(price, 4) OVER ({O}) AS d FROM ticks)
    SELECT symbol, seq, {r("CASE WHEN d IS NOT NULL THEN (-d + 8 * c - 8 * a + price) / 12 WHEN b IS NOT NULL THEN price - a ELSE 0 END", "velocity")},
    {r("CASE WHEN d IS NOT NULL THEN (-d + 16 * c - 30 * b + 16 * a - price) / 12 WHEN b IS NOT NULL THEN price - 2 * a + b ELSE 0 END", "acceleration")} FROM v"""
)
def stencil_derivatives(spark, sf_dir):
    return rounded(W.stencil(ticks(spark, sf_dir)), "velocity", "acceleration").select("symbol", "seq", "velocity", "acceleration")


@query(
    f"""{RET}, m AS (SELECT symbol, seq, ts, CASE WHEN count(ret) OVER w < 10 THEN 0 ELSE stddev_samp(ret) OVER w END AS sigma, row_number() OVER ({O}) AS n FROM rets WINDOW w AS {last(150)}
    ), e AS (SELECT symbol, seq, coalesce(list(sigma) OVER {last(50)}, []) AS x FROM m WHERE n > 150 AND n % 10 = 0
    ), w AS (SELECT *, list_transform(range(len(x)), lambda i: exp(CASE WHEN len(x) > 1 THEN i / (len(x) - 1)::DOUBLE - 1 ELSE -1 END)) AS e FROM e)
    SELECT symbol, seq, {r("list_dot_product(x, e) / list_sum(e)", "weighted_sigma", 9)} FROM w"""
)
def weighted_sigma(spark, sf_dir):
    """Mean of the last 50 sigmas with weights that grow exponentially."""
    rows = W.evaluated(rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.moments(W.log_returns(d, keys), keys=keys)))
    return rounded(W.weighted_sigma(rows), "weighted_sigma", digits=9).select("symbol", "seq", "weighted_sigma")


@query(
    f"""{RET}, w AS (SELECT symbol, seq, stddev_pop(ret) OVER {last(99)} AS vol, price - first_value(price) OVER {last(20)} AS move FROM rets)
    SELECT symbol, seq, {r("coalesce(vol, 0)", "price_vol")}, {r("move", "move_20")} FROM w"""
)
def short_windows(spark, sf_dir):
    """Deviation of the returns between the last 100 prices, and the move over the last 20."""

    def features(d, keys):
        d = W.sliding_moments(W.log_returns(d, keys), "ret", 99, keys)
        return d.withColumn("move_20", F.col("price") - F.first("price").over(W.last(20, keys)))

    out = rolling(ticks(spark, sf_dir), 101, features).withColumn("price_vol", F.coalesce(F.sqrt("__m2"), F.lit(0.0)))
    return rounded(out, "price_vol", "move_20").select("symbol", "seq", "price_vol", "move_20")


@query(
    f"""{OFI}, f AS (SELECT symbol, seq, ofi, ln(price / lag(price) OVER ({O})) AS ret, ts, price FROM flows
    ), x AS (SELECT symbol, seq, ofi, CASE WHEN count(ret) OVER {before(50)} < 50 THEN 0 ELSE sum(ret) OVER {before(50)} END AS ms, CASE WHEN count(ret) OVER {before(200)} < 200 THEN 0 ELSE sum(ret) OVER {before(200)} END AS ml,
      CASE WHEN count(price) OVER {last(200)} < 50 OR stddev_pop(price) OVER {last(200)} < 1e-12 THEN 0 ELSE (price - avg(price) OVER {last(200)}) / stddev_pop(price) OVER {last(200)} END AS mr FROM f
    ), s AS (SELECT *, CASE WHEN abs(ms) > 1e-6 AND CASE WHEN abs(ofi) > 0.01 THEN sign(ofi) ELSE 0 END = sign(ms) THEN ms * 0.3::DOUBLE ELSE 0 END AS m, CASE WHEN abs(mr) > 1.5 THEN -mr * 0.002::DOUBLE ELSE 0 END AS v FROM x)
    SELECT symbol, seq, {r("CASE WHEN abs(ml) > 0.005 THEN m * 0.7::DOUBLE + v * 0.3::DOUBLE ELSE m * 0.3::DOUBLE + v * 0.7::DOUBLE END", "prediction")}, {r("least(1, (abs(m) + abs(v)) * 100)", "confidence")} FROM s"""
)
def rule_model(spark, sf_dir):
    """Momentum that the order flow confirms and reversion of extremes, the one or the other in front by the long trend."""

    def features(d, keys):
        d = W.order_flow_imbalance(W.log_returns(d, keys), keys)
        return W.mean_reversion(W.momentum(d, keys), keys=keys)

    out = M.rule_model(rolling(ticks(spark, sf_dir), 202, features))
    return rounded(out, "prediction", "confidence").select("symbol", "seq", "prediction", "confidence")
