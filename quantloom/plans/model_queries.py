"""Queries of quality, books, decisions, exits, signals and recursive models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism
from ..functions import decisions as D
from ..operators import models as B
from ..operators import performance as P
from ..operators import quality as Q
from ..operators import scans as S
from ..operators import trades as X
from ..operators import windows as W
from ..operators.block_models import regimes_by_block, ridge_by_block
from ..operators.boosting import blended, boosted_predictions
from ..operators.tiles import rolling
from ..sources.views import fills, ticks, trades, with_views
from .common import query, r, rounded
from .performance_queries import CURVE
from .tick_queries import O, OFI, RET, lagged_returns, last

T = with_views("ticks")


def _odd(spark, sf_dir):
    """Ticks with planted faults: crossed quotes, zero volumes, spikes, clock steps."""
    t = ticks(spark, sf_dir)
    crossed, zero, spike = F.col("seq") % 97 == 0, (F.col("seq") % 400) > 330, F.col("seq") % 301 == 0
    return t.withColumns({"ask": F.when(crossed, F.col("bid") - 0.02).otherwise(F.col("ask")), "volume": F.when(zero, 0.0).when(spike, F.col("volume") * 100).otherwise(F.col("volume"))})


QUALITY = f"""{T}, f AS (SELECT symbol, seq, ts, price, bid, CASE WHEN seq % 97 = 0 THEN bid - 0.02::DOUBLE ELSE ask END AS ask,
  CASE WHEN seq % 400 > 330 THEN 0 WHEN seq % 301 = 0 THEN volume * 100 ELSE volume END AS volume FROM ticks
), a AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000::DOUBLE AS ms, ln(price / lag(price) OVER w) AS ret, row_number() OVER w AS n,
  sum(CASE WHEN volume = 0 THEN 0 ELSE 1 END) OVER w AS zg, avg(volume) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS mv FROM f WINDOW w AS (PARTITION BY symbol ORDER BY seq)
), b AS (SELECT *, CASE WHEN n > 20 THEN abs(ret) / nullif(stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING), 0) END AS z,
  CASE WHEN volume = 0 THEN sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, zg ORDER BY seq) ELSE 0 END AS zeros FROM a
), i AS (
  SELECT symbol, seq, 'TICK_GAP' AS issue, CASE WHEN ms > 1200000 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM b WHERE ms > 600000
  UNION ALL SELECT symbol, seq, 'CROSSED_MARKET', 'CRITICAL' FROM b WHERE bid > ask AND bid > 0 AND ask > 0
  UNION ALL SELECT symbol, seq, 'PRICE_JUMP', CASE WHEN z > 3 THEN 'CRITICAL' ELSE 'WARNING' END FROM b WHERE z > 2
  UNION ALL SELECT symbol, seq, 'ZERO_VOLUME', 'WARNING' FROM b WHERE zeros >= 10
  UNION ALL SELECT symbol, seq, 'VOLUME_SPIKE', 'WARNING' FROM b WHERE volume > 0 AND mv > 0 AND volume > mv * 10)"""


def _checked(spark, sf_dir):
    return Q.quality_issues(_odd(spark, sf_dir), gap_warning_ms=600_000, gap_critical_ms=1_200_000, jump_warning=2.0, jump_critical=3.0)


@query(f"{QUALITY} SELECT symbol, issue, severity, count(*) AS n FROM i GROUP BY ALL")
def quality_issues(spark, sf_dir):
    """Thresholds in minutes, as these ticks are minutes apart."""
    return Q.issue_counts(_checked(spark, sf_dir))


@query(f"{QUALITY} SELECT symbol, count(*) AS kept, max(seq) AS newest FROM f ANTI JOIN (SELECT DISTINCT symbol, seq FROM i WHERE severity = 'CRITICAL') USING (symbol, seq) GROUP BY 1")
def quality_gate(spark, sf_dir):
    return Q.quality_gate(_checked(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("kept"), F.max("seq").alias("newest"))


@query(f"{T}, g AS (SELECT symbol, seq, (epoch_us(ts) - epoch_us(lag(ts) OVER ({O}))) / 1e6::DOUBLE AS gap FROM ticks) SELECT symbol, seq, {r('gap', 'gap_s', 3)} FROM g WHERE gap > 3960")
def gap_report(spark, sf_dir):
    return rounded(Q.gaps(ticks(spark, sf_dir), 3600.0), "gap_s", digits=3)


@query(
    f"""WITH RECURSIVE {T[5:]}, o AS (SELECT *, row_number() OVER ({O}) AS n FROM ticks
    ), b AS (
      SELECT symbol, n, 0 AS bucket, volume AS total, price, 0.0::DOUBLE AS buy, volume AS vol, volume >= 500 AS done FROM o WHERE n = 1
      UNION ALL
      SELECT o.symbol, o.n, b.bucket + CASE WHEN b.done THEN 1 ELSE 0 END, o.volume + CASE WHEN b.done THEN 0 ELSE b.total END, o.price,
        CASE WHEN NOT b.done AND o.price >= b.price THEN o.volume ELSE 0 END, o.volume, o.volume + CASE WHEN b.done THEN 0 ELSE b.total END >= 500
      FROM b JOIN o ON o.symbol = b.symbol AND o.n = b.n + 1
    ), c AS (SELECT symbol, bucket, abs(2 * sum(buy) - sum(vol)) / greatest(sum(vol), 1e-10) AS imbalance FROM b GROUP BY 1, 2 HAVING bool_or(done))
    SELECT symbol, bucket::BIGINT AS bucket, {r("imbalance", "imbalance")}, {r("avg(imbalance) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "vpin")} FROM c"""
)
def vpin_buckets(spark, sf_dir):
    return rounded(S.toxicity(ticks(spark, sf_dir)), "imbalance", "vpin").select("symbol", "bucket", "imbalance", "vpin")


@query(
    f"""WITH RECURSIVE {T[5:]}, o AS (SELECT symbol, seq, price, row_number() OVER ({O}) AS n FROM ticks
    ), k AS (
      SELECT symbol, seq, n, price AS level, 1.0::DOUBLE AS err FROM o WHERE n = 1
      UNION ALL
      SELECT o.symbol, o.seq, o.n, k.level + (k.err + 1e-4) / (k.err + 1e-4 + 1e-2) * (o.price - k.level), (1 - (k.err + 1e-4) / (k.err + 1e-4 + 1e-2)) * (k.err + 1e-4) FROM k JOIN o ON o.symbol = k.symbol AND o.n = k.n + 1)
    SELECT symbol, seq, {r("level", "level")} FROM k"""
)
def kalman_level(spark, sf_dir):
    return rounded(S.kalman_level(ticks(spark, sf_dir)), "level")


@query(
    f"""WITH RECURSIVE {T[5:]}, o AS (SELECT symbol, seq, price AS z, row_number() OVER ({O}) AS n FROM ticks
    ), k AS (
      SELECT symbol, seq, n, z AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22 FROM o WHERE n = 1
      UNION ALL
      SELECT symbol, seq, n, y0 + m00 / (m00 + 1e-4) * (z - y0), y1 + m01 / (m00 + 1e-4) * (z - y0), y2 + m02 / (m00 + 1e-4) * (z - y0),
        m00 - m00 / (m00 + 1e-4) * m00, m01 - m00 / (m00 + 1e-4) * m01, m02 - m00 / (m00 + 1e-4) * m02, m11 - m01 / (m00 + 1e-4) * m01, m12 - m01 / (m00 + 1e-4) * m02, m22 - m02 / (m00 + 1e-4) * m02
      FROM (SELECT o.symbol, o.seq, o.n, o.z, x0 + x1 + 0.5::DOUBLE * x2 AS y0, x1 + x2 AS y1, x2 AS y2,
        (p00 + p01 + 0.5::DOUBLE * p02) + (p01 + p11 + 0.5::DOUBLE * p12) + 0.5::DOUBLE * (p02 + p12 + 0.5::DOUBLE * p22) + 1e-6 AS m00, (p01 + p11 + 0.5::DOUBLE * p12) + (p02 + p12 + 0.5::DOUBLE * p22) AS m01, p02 + p12 + 0.5::DOUBLE * p22 AS m02,
        (p11 + p12) + (p12 + p22) + 1e-5 AS m11, p12 + p22 AS m12, p22 + 1e-4 AS m22 FROM k JOIN o ON o.symbol = k.symbol AND o.n = k.n + 1) q)
    SELECT symbol, seq, {r("x1", "velocity")}, {r("x2", "acceleration")} FROM k"""
)
def kalman_derivatives(spark, sf_dir):
    """Velocity and acceleration of the price; compared with a numpy twin in the tests too."""
    return rounded(S.kalman_derivatives(ticks(spark, sf_dir)), "velocity", "acceleration")


STATE = ("mu", "sigma", "skew", "kurt")  # the full state has the tail slope and the entropy besides, see feature_vector


def _states(spark, sf_dir):
    return W.evaluated(rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.moments(W.log_returns(d, keys), keys=keys)))


def _states_and_momentum(spark, sf_dir):
    """The rolling moments with momentum; tiles are sorted many times, so they are dealt by number."""
    return W.evaluated(rolling(ticks(spark, sf_dir), 202, lambda d, keys: W.momentum(W.moments(W.log_returns(d, keys), keys=keys), keys), tasks=default_parallelism(spark)))


@query()
def hmm_regimes(spark, sf_dir):
    """Regimes of the rolling moments on evaluation rows."""
    return rounded(S.hmm_regimes(_states(spark, sf_dir), STATE), "confidence", "entropy")


@query()
def online_predictions(spark, sf_dir):
    """Return of the next evaluation row from the moments of this one."""
    rows = _states(spark, sf_dir).withColumn("target", F.coalesce(F.lead("mu").over(W.ordered()), F.lit(0.0)))
    return rounded(S.online_predictions(rows, STATE, "target"), "actual", "prediction", "confidence")


@query()
def garch_volatility(spark, sf_dir):
    return rounded(S.garch_sigma(lagged_returns(spark, sf_dir).where("ret IS NOT NULL")), "sigma")


@query(
    f"""WITH RECURSIVE {T[5:]}, o AS (SELECT symbol, seq, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER ({O}) AS n FROM ticks
    ), s AS (
      SELECT symbol, seq, n, true AS admitted, [t] AS passed FROM o WHERE n = 1
      UNION ALL
      SELECT symbol, seq, n, ok, CASE WHEN ok THEN list_append(passed, t)[-5:] ELSE passed END FROM (
        SELECT o.symbol, o.seq, o.n, o.t, s.passed, len(list_filter(s.passed, lambda x: x > o.t - 600)) < 2 AND len(list_filter(s.passed, lambda x: x > o.t - 3600)) < 5 AS ok FROM s JOIN o ON o.symbol = s.symbol AND o.n = s.n + 1) q)
    SELECT symbol, seq, admitted FROM s"""
)
def rate_limits(spark, sf_dir):
    """Two orders in ten minutes and five in an hour."""
    return S.rate_limited(ticks(spark, sf_dir), per_second=2, per_minute=5, second=600.0, minute=3600.0)


@query(f"{CURVE} SELECT symbol, count(*) AS n, count(*) FILTER (halted) AS halted FROM (SELECT symbol, max(dd <= -0.01) OVER (PARTITION BY symbol ORDER BY ts, order_id, line, pnl ROWS UNBOUNDED PRECEDING) AS halted FROM d) GROUP BY 1")
def kill_switch(spark, sf_dir):
    out = X.kill_switch(P.equity_curve(trades(spark, sf_dir), 1_000_000.0), 0.01)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.when(F.col("halted"), 1).otherwise(0)).alias("halted"))


@query(
    f"""{T}, m AS (SELECT *, row_number() OVER ({O}) AS k, CAST(floor(price / 20) AS BIGINT) % 3 AS regime FROM ticks), l AS (SELECT *, lag(regime) OVER ({O}) AS was FROM m
    ), e AS (SELECT symbol, k AS ek, price AS p0, CASE WHEN regime > was THEN 'BUY' ELSE 'SELL' END AS side FROM l WHERE regime <> was
    ), p AS (SELECT e.symbol, ek, side, m.k, m.k - ek AS age, price, p0, CASE WHEN side = 'BUY' THEN price / p0 - 1 ELSE 1 - price / p0 END AS ret FROM e JOIN m ON m.symbol = e.symbol AND m.k BETWEEN ek + 1 AND ek + 80
    ), q AS (SELECT *, greatest(0, max(ret) OVER w) AS best, greatest(p0, max(price) OVER w) AS pk, least(p0, min(price) OVER w) AS tr FROM p WINDOW w AS (PARTITION BY symbol, ek ORDER BY k)
    ), d AS (SELECT *, CASE WHEN side = 'BUY' THEN (pk - price) / pk ELSE (price - tr) / tr END AS fall FROM q
    ), x AS (SELECT *, CASE WHEN ret <= -0.5 THEN 'STOP_LOSS' WHEN best > 0.8 * 0.6 AND fall >= 0.3 * CASE WHEN best >= 1.5 * 0.8 THEN 0.5 ELSE 0.7 END THEN 'TRAILING_STOP' WHEN ret >= 0.8 THEN 'TAKE_PROFIT' WHEN age >= 80 THEN 'MAX_HOLD' END AS reason FROM d)
    SELECT symbol, ek AS k, side, min(k) AS exit_k, arg_min(reason, k) AS reason, {r("arg_min(ret, k)", "ret")} FROM x WHERE reason IS NOT NULL GROUP BY 1, 2, 3"""
)
def exit_automaton(spark, sf_dir):
    """Entries at every change of the price regime, up or down with it."""
    regime = F.floor(F.col("price") / 20) % 3
    was = F.lag(regime).over(W.ordered())
    marks = ticks(spark, sf_dir).withColumn("side", F.when(regime > was, "BUY").when(regime < was, "SELL"))
    return rounded(X.exits(marks.withColumns({"stop": F.lit(0.5), "take_profit": F.lit(0.8), "trail": F.lit(0.3)})), "ret")


@query(
    f"""{T}, g AS (SELECT symbol, seq, ts, CAST(floor(price / 20) AS BIGINT) % 3 AS regime, row_number() OVER ({O}) AS n FROM ticks
    ), c AS (SELECT *, coalesce(regime <> lag(regime) OVER ({O}), true) AS ch FROM g), s AS (SELECT regime, (epoch_us(lead(ts) OVER ({O})) - epoch_us(ts)) / 1e6::DOUBLE AS s FROM c WHERE ch)
    SELECT regime, count(*) AS visits, {r("avg(s)", "mean_s", 3)} FROM s GROUP BY 1"""
)
def regime_dwell(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("regime_id", F.floor(F.col("price") / 20) % 3)
    return rounded(X.dwell_times(t), "mean_s", digits=3)


@query(
    f"""{RET}, s AS (SELECT symbol, seq, ts, ret, CASE WHEN ret > 0 THEN -0.5::DOUBLE ELSE 0.5 END AS a, CASE WHEN seq % 3 = 0 THEN 0 ELSE coalesce(sign(ret), 0) * 0.4::DOUBLE END AS b FROM rets WHERE ret IS NOT NULL
    ), l AS (SELECT *, lag(a) OVER ({O}) AS wa, lag(b) OVER ({O}) AS wb FROM s
    ), c AS (SELECT *, CASE WHEN wa IS NOT NULL THEN CASE WHEN wa * ret > 0 OR abs(wa) < 1e-8 THEN 1.0::DOUBLE ELSE 0 END END AS ra, CASE WHEN wb IS NOT NULL THEN CASE WHEN wb * ret > 0 OR abs(wb) < 1e-8 THEN 1.0::DOUBLE ELSE 0 END END AS rb FROM l
    ), w AS (SELECT *, greatest(0.05::DOUBLE, coalesce(avg(ra) OVER {last(100)}, 0.35::DOUBLE) - 0.3::DOUBLE) AS x, greatest(0.05::DOUBLE, coalesce(avg(rb) OVER {last(100)}, 0.35::DOUBLE) - 0.3::DOUBLE) AS y FROM c)
    SELECT symbol, seq, {r("x / (x + y)", "w_a")}, {r("y / (x + y)", "w_b")}, {r("greatest(-1, least(1, (x * a + y * b) / (x + y)))", "direction", 9)} FROM w"""
)
def signal_weights(spark, sf_dir):
    """A reversal and a momentum signal weighed by their accuracy."""
    t = lagged_returns(spark, sf_dir).where("ret IS NOT NULL")
    t = t.withColumn("a", F.when(F.col("ret") > 0, -0.5).otherwise(0.5)).withColumn("b", F.when(F.col("seq") % 3 == 0, 0.0).otherwise(F.coalesce(F.signum("ret"), F.lit(0.0)) * 0.4))
    return rounded(rounded(rolling(t, 100, lambda d, keys: X.signal_weights(d, ("a", "b"), keys=keys)), "w_a", "w_b"), "direction", digits=9).select("symbol", "seq", "w_a", "w_b", "direction")


@query(
    f"""{OFI}, m AS (SELECT symbol, ofi, price - lag(price) OVER ({O}) AS ch FROM flows), v AS (SELECT * FROM m WHERE ch IS NOT NULL
    ), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY ofi) + (count(*) OVER (PARTITION BY symbol, ofi) - 1) / 2::DOUBLE AS x, rank() OVER (PARTITION BY symbol ORDER BY ch) + (count(*) OVER (PARTITION BY symbol, ch) - 1) / 2::DOUBLE AS y FROM v)
    SELECT symbol, count(*) AS n, {r("corr(x, y)", "ic")} FROM k GROUP BY 1"""
)
def spearman_ic(spark, sf_dir):
    """Rank correlation of order flow and price change."""
    t = W.order_flow_imbalance(ticks(spark, sf_dir)).withColumn("ch", F.col("price") - F.lag("price").over(W.ordered())).where("ch IS NOT NULL")
    return rounded(X.spearman(t, "ofi", "ch", ("symbol",)), "ic")


@query(f"{OFI}, m AS (SELECT symbol, ofi, price - lag(price) OVER ({O}) AS ch FROM flows) SELECT symbol, count(*) AS n, {r('avg(CASE WHEN sign(ofi) = sign(ch) THEN 1.0::DOUBLE ELSE 0 END)', 'hit_rate')} FROM m WHERE ch IS NOT NULL AND abs(ofi) >= 0.01 GROUP BY 1")
def hit_rate(spark, sf_dir):
    t = W.order_flow_imbalance(ticks(spark, sf_dir)).withColumn("ch", F.col("price") - F.lag("price").over(W.ordered())).where("ch IS NOT NULL")
    return rounded(X.hit_rate(t, "ofi", "ch", ("symbol",)), "hit_rate")


@query(
    f"""{T}, i AS (SELECT symbol, seq, 0.1::DOUBLE * 0.02 * sqrt(volume / 1000) AS t, 0.05::DOUBLE * 0.02 * (volume / 1000) AS p, price, volume FROM ticks)
    SELECT symbol, seq, {r("(t + p) * 10000", "bps")}, {r("(t + p) * price * volume", "cost")}, (t + p) * 10000 <= 5 AS acceptable FROM i"""
)
def market_impact(spark, sf_dir):
    """Square-root impact of trading each tick's volume."""
    i = D.market_impact(F.col("volume"), F.col("price"), F.lit(0.02), F.lit(1000.0), most_bps=5.0)
    out = ticks(spark, sf_dir).withColumn("i", i).select("symbol", "seq", "i.bps", "i.cost", "i.acceptable")
    return rounded(out, "bps", "cost")


@query(
    f"""{T} SELECT symbol, seq, {r('2 * ((ask - bid) / 2 + 0.0001::DOUBLE * sqrt(volume)) / price', 'cost')}, CASE WHEN price / 1000 >= 0.05 THEN 5.0::DOUBLE WHEN price / 1000 >= 0.02 THEN 2.5 WHEN price / 1000 >= 0.01 THEN 1.5 ELSE 1.0 END AS multiplier FROM ticks"""
)
def slippage_costs(spark, sf_dir):
    """Round-trip cost and the multiplier of a volatility level."""
    cost = D.round_trip_cost(F.col("price"), F.col("volume"), F.col("bid"), F.col("ask"))
    return rounded(ticks(spark, sf_dir).select("symbol", "seq", cost.alias("cost"), D.regime_multiplier(F.col("price") / 1000).alias("multiplier")), "cost")


@query(
    f"""{T}, b AS (SELECT symbol, seq, price AS mid, 1 + seq % 7 AS d FROM ticks), l AS (SELECT *, [d * (1 + i * 0.5::DOUBLE) for i in range(5)] AS s, [mid + 0.01::DOUBLE * (i + 1) for i in range(5)] AS p FROM b
    ), c AS (SELECT symbol, seq, unnest(s) AS size, unnest(p) AS price, unnest(range(5)) AS i, 10.0::DOUBLE AS q FROM l
    ), f AS (SELECT *, greatest(0, least(size, q - coalesce(sum(size) OVER (PARTITION BY symbol, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM c)
    SELECT symbol, seq, {r("sum(take)", "filled")}, {r("sum(take * price) / sum(take)", "average")}, {r("sum(size) FILTER (i < 3) * 0.05::DOUBLE", "capacity")} FROM f GROUP BY 1, 2"""
)
def book_walk(spark, sf_dir):
    """A market order of ten against a synthetic ladder, and the depth that may be taken."""
    t = ticks(spark, sf_dir).withColumn("asks", D.levels(F.col("price"), F.lit(0.01), (1 + F.col("seq") % 7).cast("double"), 1))
    out = t.withColumn("fill", D.walk_book(F.col("asks"), F.lit(10.0))).select("symbol", "seq", "fill.filled", "fill.average", (D.top_depth(F.col("asks")) * 0.05).alias("capacity"))
    return rounded(out, "filled", "average", "capacity")


@query(
    f"""{T}, w AS (SELECT symbol, seq, list_sum([bid_size * (1 + i * 0.5::DOUBLE) / (1 + i) for i in range(5)]) AS b, list_sum([ask_size * (1 + i * 0.5::DOUBLE) / (1 + i) for i in range(5)]) AS a FROM ticks)
    SELECT symbol, seq, {r("(b - a) / (b + a)", "pressure")} FROM w"""
)
def book_pressure(spark, sf_dir):
    mid = (F.col("bid") + F.col("ask")) / 2
    pressure = D.book_pressure(D.levels(mid, F.lit(0.01), F.col("bid_size"), -1), D.levels(mid, F.lit(0.01), F.col("ask_size"), 1))
    return rounded(ticks(spark, sf_dir).select("symbol", "seq", pressure.alias("pressure")), "pressure")


@query(
    f"""{with_views("fills")}, l AS (SELECT *, lag(price) OVER w AS lp, lag(side) OVER w AS ls, epoch(ts) - epoch(lag(ts) OVER w) AS since FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY ts, order_id, line, qty)
    ), c AS (SELECT CASE WHEN lp > 0 AND abs(price - lp) / lp > 0.5 THEN 'PRICE_COLLAR' WHEN qty * price > 60000 THEN 'ORDER_SIZE' WHEN abs(CASE WHEN side = 'BUY' THEN qty * price ELSE -qty * price END) > 50000 THEN 'POSITION_LIMIT' WHEN ls <> side AND since < 86400 THEN 'WASH_TRADE' ELSE 'OK' END AS reason FROM l)
    SELECT reason, count(*) AS n FROM c GROUP BY 1"""
)
def compliance_reasons(spark, sf_dir):
    """First rule broken by each fill taken as an order after the one before it; fills that the SQL leaves in any order go by price and side."""
    w = Window.partitionBy("symbol").orderBy("ts", "order_id", "line", "qty", "price", "side")
    f = fills(spark, sf_dir).withColumns({"lp": F.lag("price").over(w), "ls": F.lag("side").over(w), "since": F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))})
    reason = D.compliance_reason(F.col("price"), F.coalesce("lp", F.lit(0.0)), F.col("qty"), F.col("side"), F.lit(0.0), F.col("ls"), F.col("since"), F.lit(0.0), collar=0.5, order_cap=60_000.0, position_cap=50_000.0, wash_s=86_400.0)
    return f.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""{RET}, m AS (SELECT symbol, seq, stddev_samp(ret) OVER {last(150)} AS v, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret IS NOT NULL THEN 0 END) OVER {last(150)} AS wr, row_number() OVER ({O}) AS n FROM rets
    ), k AS (SELECT *, greatest(0, least(1, wr - (1 - wr) / 1.5::DOUBLE)) AS raw, greatest(0.001::DOUBLE, v * 0.6 * 0.8) AS stop FROM m WHERE n > 150
    ), z AS (SELECT *, CASE WHEN raw < 0.01 THEN greatest(raw * 0.5, 0.005::DOUBLE) ELSE raw * 0.5 END AS risk FROM k)
    SELECT symbol, seq, {r("raw", "kelly")}, {r("least(100000 * risk / (50 * stop) * 1.0, 100000 * 0.02 / (50 * stop), 100000 / 50::DOUBLE)", "size")} FROM z"""
)
def position_sizes(spark, sf_dir):
    """Risked quantity of an account of 100000 at a price of 50, from rolling win rate and volatility."""

    def features(d, keys):
        w = W.last(150, keys)
        return W.log_returns(d, keys).withColumns({"v": F.stddev_samp("ret").over(w), "wr": F.avg(F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)).over(w)})

    t = rolling(ticks(spark, sf_dir), 151, features)
    stop = F.greatest(F.lit(0.001), F.col("v") * 0.6 * 0.8)
    size = D.position_size(F.lit(100_000.0), F.lit(50.0), stop, F.col("wr"), F.lit(1.5), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return rounded(t.where("n > 150").select("symbol", "seq", D.kelly(F.col("wr"), F.lit(1.5)).alias("kelly"), size.alias("size")), "kelly", "size")


@query(
    f"""{RET}, s AS (SELECT symbol, seq, ret AS v, ret - lag(ret) OVER ({O}) AS a, least(1, abs(ret)) AS st, (bid_size - ask_size) / (bid_size + ask_size) AS im FROM rets), d AS (SELECT *, seq % 3 = 0 AS trending,
      (v > 0 AND (a < 0 OR abs(a) < abs(v) * 0.5)) AS up, (v < 0 AND (a > 0 OR abs(a) < abs(v) * 0.5)) AS down FROM s
    ), x AS (SELECT symbol, CASE WHEN up THEN CASE WHEN trending THEN 'BUY' ELSE 'SELL' END WHEN down THEN CASE WHEN trending THEN 'SELL' ELSE 'BUY' END
      WHEN v > 0 THEN CASE WHEN trending THEN CASE WHEN st >= 0.3 AND im > -0.3 THEN 'BUY' END ELSE CASE WHEN st >= 0.3 AND im < 0.3 THEN 'SELL' END END
      WHEN v < 0 THEN CASE WHEN trending THEN CASE WHEN st >= 0.3 AND im < 0.3 THEN 'SELL' END ELSE CASE WHEN st >= 0.3 AND im > -0.3 THEN 'BUY' END END END AS action FROM d)
    SELECT symbol, action, count(*) AS n FROM x GROUP BY ALL"""
)
def entry_actions(spark, sf_dir):
    """Entry table with returns as velocity and every third tick taken as trending."""
    t = W.log_returns(ticks(spark, sf_dir))
    t = t.withColumn("a", F.col("ret") - F.lag("ret").over(W.ordered())).withColumn("im", (F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size")))
    action = D.entry_action(F.lit(1.0), F.lit(1.0), F.col("ret"), F.col("a"), F.lit(0.0), F.least(F.lit(1.0), F.abs("ret")), F.when(F.col("seq") % 3 == 0, 1.0).otherwise(0.0), F.col("im"), F.lit(True))
    return t.select("symbol", action.alias("action")).groupBy("symbol", "action").agg(F.count("*").alias("n"))


def book_events(t):
    """Ticks taken as inserts, updates and deletes of the first five levels of a book."""
    return t.select(
        "symbol", "seq", "ts", (F.col("seq") % 3).cast("int").alias("operation"), F.when(F.col("seq") % 2 == 0, "BID").otherwise("ASK").alias("side"),
        (F.floor(F.col("seq") / 6) % 5).cast("int").alias("level"), "price", F.col("volume").alias("size"),
    )


@query()
def book_dynamics(spark, sf_dir):
    """A book fed by the ticks taken as operations on its first five levels."""
    return rounded(B.book_dynamics(book_events(ticks(spark, sf_dir))), "bid_depth", "ask_depth", "pull_bid", "pull_ask", "spoofing")


@query()
def regime_transitions(spark, sf_dir):
    """Changes between the regimes that the hidden Markov model finds in the rolling moments."""
    states = _states(spark, sf_dir)
    rows = states.join(S.hmm_regimes(states, STATE).select("symbol", "seq", "regime_id"), ["symbol", "seq"])
    return rounded(B.regime_transitions(rows, STATE, (1.0, 5.0, 1.0, 0.5)), "strength", "probability", "velocity", "acceleration")


@query()
def ensemble_predictions(spark, sf_dir):
    """Ridge, regime and momentum models weighed by their errors."""
    rows = _states_and_momentum(spark, sf_dir)
    rows = rows.withColumn("target", F.coalesce(F.lead("mu").over(W.ordered()), F.lit(0.0))).withColumn("regime_id", F.when(F.col("skew") > 0, 1).otherwise(0))
    return rounded(B.ensemble_predictions(rows, STATE, "target", "mom_50"), "prediction", "disagreement", "w_ridge", "w_regime", "w_momentum")


@query()
def boosted_block_predictions(spark, sf_dir):
    """The next mean return of each evaluation row by trees refitted every 100 rows; the tests compare fits and predictions with plain ones."""
    rows = _states_and_momentum(spark, sf_dir)
    rows = rows.drop("n").withColumn("target", F.lead("mu").over(W.ordered()))
    out = boosted_predictions(rows, (*STATE, "mom_50"), "target", block=100, keep=1000, least_rows=80)
    return rounded(out.select("symbol", "seq", "gbt", "gbt_block", "gbt_accepted"), "gbt", digits=9)


@query()
def regime_blocks(spark, sf_dir):
    """Regimes of the rolling moments by models refitted every 100 rows, filtered from block to block; the tests compare them with one loop."""
    rows = _states(spark, sf_dir).drop("n")
    return rounded(regimes_by_block(rows, STATE), "confidence", "entropy").select("symbol", "seq", "regime_id", "confidence", "entropy")


@query()
def ridge_blocks(spark, sf_dir):
    """The next mean return of each evaluation row by ridge regressions of its symbol, and of its symbol and the sign of its skewness; the tests compare them with weighted least squares."""
    rows = _states(spark, sf_dir).drop("n").withColumn("target", F.lead("mu").over(W.ordered())).withColumn("regime_id", F.when(F.col("skew") > 0, 1).otherwise(0))
    own = ridge_by_block(rows, STATE, "target", into="ridge")
    both = ridge_by_block(own, STATE, "target", ("symbol", "regime_id"), into="by_regime")
    return rounded(both.select("symbol", "seq", "regime_id", "ridge", "ridge_r2", "by_regime", "by_regime_r2"), "ridge", "ridge_r2", "by_regime", "by_regime_r2", digits=9)


def ensemble_members(rows, block=100, **fitting):
    """``rows`` with the predictions of four models of ``target``, each made before the row is learned: ``ridge``, ``by_regime``, ``momentum`` and ``gbt``."""
    own = ridge_by_block(rows, STATE, "target", into="ridge", block=block)
    both = ridge_by_block(own, STATE, "target", ("symbol", "regime_id"), into="by_regime", block=block).drop("ridge_r2", "by_regime_r2")
    return boosted_predictions(both.withColumn("momentum", 0.1 * F.col("mom_50")), (*STATE, "mom_50"), "target", block=block, **fitting)


@query()
def ensemble_blocks(spark, sf_dir):
    """Ridge, regime, momentum and boosted models of the next mean return by block, weighed by their recent errors; the tests compare the blend with a plain loop."""
    rows = _states_and_momentum(spark, sf_dir).drop("n")
    rows = rows.withColumn("target", F.lead("mu").over(W.ordered())).withColumn("regime_id", F.when(F.col("skew") > 0, 1).otherwise(0))
    members = ensemble_members(rows, keep=1000, least_rows=80)
    out = blended(members, MEMBERS, "target")
    cols = (*MEMBERS, "blend", "disagreement", *(f"w_{m}" for m in MEMBERS))
    return rounded(out, *cols, digits=9).select("symbol", "seq", "target", *cols)


MEMBERS = ("ridge", "by_regime", "momentum", "gbt")
