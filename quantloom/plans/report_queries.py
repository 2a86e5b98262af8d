"""Queries of reports over signals, predictions, trades and trials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism
from ..functions import normal
from ..operators import performance as P
from ..operators import reports as R
from ..operators import windows as W
from ..operators.boosting import blended, rollbacks
from ..operators.ranks import rank_correlation, rank_sum
from ..operators.tiles import numbered, rolling
from ..operators.unit_roots import stationarity_tests
from ..sources.views import fills, order_log, table, ticks, trades, with_views
from .common import query, r, rounded
from .performance_queries import CURVE
from .tick_queries import OFI, RET, O, before, lagged_returns, last

T, TR, FL = with_views("ticks"), with_views("trades"), with_views("fills")

SIGNALS = f"""{OFI}, s AS (SELECT symbol, seq, ts, ofi, volume, price - lag(price) OVER ({O}) AS ch, lead(price) OVER ({O}) - price AS ret FROM flows
), g AS (SELECT 'flow/' || symbol AS name, ts, seq, ofi / 10 AS value, 0.5::DOUBLE AS weight, ret FROM s UNION ALL SELECT 'reversal/' || symbol, ts, seq, -ch / 10, 0.3::DOUBLE, ret FROM s UNION ALL SELECT 'volume/' || symbol, ts, seq, (volume - 50) / 50, 0.2::DOUBLE, ret FROM s
), v AS (SELECT * FROM g WHERE value IS NOT NULL AND ret IS NOT NULL)"""


def _signals(spark, sf_dir):
    """Three signals of each tick with the move that follows."""

    def features(d, keys):
        w = W.ordered(keys)
        return W.order_flow_imbalance(d, keys).withColumns({"ch": F.col("price") - F.lag("price").over(w), "ret": F.lead("price").over(w) - F.col("price")})

    d = rolling(ticks(spark, sf_dir), 1, features, lookahead=1, tasks=default_parallelism(spark))
    each = F.array(
        F.struct(F.lit("flow").alias("kind"), (F.col("ofi") / 10).alias("value"), F.lit(0.5).alias("weight")),
        F.struct(F.lit("reversal").alias("kind"), (-F.col("ch") / 10).alias("value"), F.lit(0.3).alias("weight")),
        F.struct(F.lit("volume").alias("kind"), ((F.col("volume") - 50) / 50).alias("value"), F.lit(0.2).alias("weight")),
    )
    d = d.select("symbol", F.struct("ts", "seq").alias("at"), "ret", F.inline(each)).where("value IS NOT NULL AND ret IS NOT NULL")
    return d.withColumn("name", F.concat_ws("/", "kind", "symbol"))


@query(
    f"""{SIGNALS}, c AS (SELECT *, weight * abs(value) * sign(value * ret) AS contribution, sign(value) = sign(ret) AND abs(value) > 1e-10 AND abs(ret) > 1e-10 AS correct, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS back FROM v
    ), k AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2::DOUBLE AS x, rank() OVER (PARTITION BY name ORDER BY ret) + (count(*) OVER (PARTITION BY name, ret) - 1) / 2::DOUBLE AS y FROM c WHERE back <= 1000
    ), i AS (SELECT name, corr(x, y) AS ic FROM k GROUP BY 1
    ), sums AS (SELECT name, sum(contribution) AS total, count(*) FILTER (back <= 1000) AS n, avg(correct::INT) FILTER (back <= 1000) AS hit_rate, avg(abs(value)) FILTER (back <= 1000) AS magnitude, avg(weight) FILTER (back <= 1000) AS weight,
      coalesce(avg(contribution) FILTER (back <= 1000 AND correct), 0) AS when_right, coalesce(avg(contribution) FILTER (back <= 1000 AND NOT correct), 0) AS when_wrong, avg(correct::INT) FILTER (back <= 100) AS newest, count(*) AS c FROM c GROUP BY 1)
    SELECT name, n, {r("total", "total")}, {r("hit_rate", "hit_rate")}, {r("magnitude", "magnitude")}, {r("weight", "weight")}, {r("when_right", "when_right")}, {r("when_wrong", "when_wrong")}, {r("ic", "ic")},
    c >= 100 AND newest < 0.45 AND total < 0 AS dead, CAST(row_number() OVER (ORDER BY total DESC, name) AS INTEGER) AS "rank" FROM sums JOIN i USING (name)"""
)
def signal_summary(spark, sf_dir):
    """What each signal earned, how often it was right, its rank, and whether it is dead."""
    return rounded(R.signal_summary(_signals(spark, sf_dir)), "total", "hit_rate", "magnitude", "weight", "when_right", "when_wrong", "ic")


@query(
    f"""{SIGNALS}, b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS back FROM v), names AS (SELECT DISTINCT name FROM v UNION ALL SELECT 'silent')
    SELECT name, count(b.ret) AS n, {r("coalesce(avg(CASE WHEN value * ret > 0 THEN 1.0::DOUBLE WHEN b.ret IS NOT NULL THEN 0 END), 0.5::DOUBLE)", "accuracy")} FROM names LEFT JOIN b USING (name) WHERE coalesce(back, 1) <= 200 GROUP BY 1"""
)
def signal_accuracy(spark, sf_dir):
    """Accuracy of each signal's last 200 rows, a half for one that never spoke."""
    s = _signals(spark, sf_dir)
    w = Window.partitionBy("name").orderBy(F.desc("at"))
    recent = s.withColumn("back", F.row_number().over(w)).where("back <= 200").select("name", "value", "ret")  # every name has a last row
    silent = spark.createDataFrame([("silent", None, None)], "name string, value double, ret double")
    out = recent.union(silent).groupBy("name").agg(
        F.count("ret").alias("n"), F.coalesce(F.avg(F.when(F.col("value") * F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)), F.lit(0.5)).alias("accuracy")
    )
    return rounded(out, "accuracy")


PAIRS = f"""{RET}, p AS (SELECT symbol, seq, ts, -ret / 4 AS prediction FROM rets WHERE ret IS NOT NULL), o AS (SELECT symbol, seq, ts, ret AS actual FROM rets WHERE ret IS NOT NULL AND seq > 50
), pk AS (SELECT *, row_number() OVER ({O}) AS k FROM p), ok AS (SELECT *, row_number() OVER ({O}) AS k FROM o), j AS (SELECT pk.symbol, k, pk.seq AS predicted_at, ok.seq AS realised_at, prediction, actual FROM pk JOIN ok USING (symbol, k))"""


def _pairs(spark, sf_dir):
    """Predictions from each return and outcomes that begin later, so that they pair first in, first out."""
    d = lagged_returns(spark, sf_dir).where("ret IS NOT NULL")
    predictions = d.select("symbol", "ts", "seq", (-F.col("ret") / 4).alias("prediction"))
    return R.paired(predictions, d.where("seq > 50").select("symbol", "ts", "seq", F.col("ret").alias("actual")), ("symbol",))


@query(f"{PAIRS} SELECT symbol, k, predicted_at, realised_at, {r('prediction', 'prediction')}, {r('actual', 'actual')} FROM j")
def prediction_pairs(spark, sf_dir):
    """The k-th prediction of a symbol with its k-th outcome."""
    out = rounded(_pairs(spark, sf_dir), "prediction", "actual")
    return out.select("symbol", F.col("k").cast("long").alias("k"), "predicted_at", "realised_at", "prediction", "actual")


@query(
    f"""{PAIRS}, x AS (SELECT symbol, prediction AS p, actual AS a, rank() OVER (PARTITION BY symbol ORDER BY prediction) + (count(*) OVER (PARTITION BY symbol, prediction) - 1) / 2::DOUBLE AS rp, rank() OVER (PARTITION BY symbol ORDER BY actual) + (count(*) OVER (PARTITION BY symbol, actual) - 1) / 2::DOUBLE AS ra FROM j)
    SELECT symbol, count(*) AS n, {r("avg(abs(a - p))", "mae")}, {r("sqrt(avg((a - p) ** 2))", "rmse")}, {r("avg(CASE WHEN sign(p) = sign(a) THEN 1.0::DOUBLE ELSE 0 END)", "accuracy")},
    {r("greatest(-1, least(1, 1 - sum((a - p) ** 2) / greatest(var_pop(a) * count(*), 1e-10)))", "r2")}, {r("corr(rp, ra)", "ic")}, abs(corr(rp, ra)) > 0.03 AND avg(CASE WHEN sign(p) = sign(a) THEN 1.0::DOUBLE ELSE 0 END) > 0.52 AS edge FROM x GROUP BY 1"""
)
def predictor_metrics(spark, sf_dir):
    """Errors of the paired predictions, and whether they have an edge."""
    out = R.predictor_metrics(_pairs(spark, sf_dir), ("symbol",))
    out = out.withColumn("edge", (F.abs("ic") > 0.03) & (F.col("accuracy") > 0.52))
    return rounded(out, "mae", "rmse", "accuracy", "r2", "ic")


@query(
    f"""{RET}, m AS (SELECT symbol, ts, seq, 'fade' AS model, -lag(ret) OVER ({O}) / 4 AS p, ret AS a FROM rets UNION ALL SELECT symbol, ts, seq, 'follow', lag(ret) OVER ({O}) / 4, ret FROM rets UNION ALL SELECT symbol, ts, seq, 'zero', 0.0::DOUBLE, ret FROM rets
    ), w AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY ts DESC, seq DESC) AS back FROM m WHERE p IS NOT NULL AND a IS NOT NULL
    ), g AS (SELECT symbol, model, avg(abs(a - p)) AS mae, avg(CASE WHEN sign(p) = sign(a) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM w WHERE back <= 100 GROUP BY 1, 2)
    SELECT symbol, model, {r("mae", "mae")}, {r("accuracy", "accuracy")}, {r("1 / mae / sum(1 / mae) OVER (PARTITION BY symbol)", "weight")}, row_number() OVER (PARTITION BY symbol ORDER BY mae, model) = 1 AS best FROM g"""
)
def model_errors(spark, sf_dir):
    """Mean error of the last 100 predictions of three models, the weight that its inverse gives, and the best of them."""
    w = W.ordered()
    d = W.log_returns(ticks(spark, sf_dir)).withColumn("was", F.lag("ret").over(w))
    each = F.array(*(F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in (("fade", -F.col("was") / 4), ("follow", F.col("was") / 4), ("zero", F.lit(0.0)))))
    d = d.select("symbol", "ts", "seq", F.col("ret").alias("a"), F.inline(each)).where("p IS NOT NULL AND a IS NOT NULL")
    back = Window.partitionBy("symbol", "model").orderBy(F.desc("ts"), F.desc("seq"))
    g = d.withColumn("back", F.row_number().over(back)).where("back <= 100").groupBy("symbol", "model").agg(
        F.avg(F.abs(F.col("a") - F.col("p"))).alias("mae"), F.avg(F.when(F.signum("p") == F.signum("a"), 1.0).otherwise(0.0)).alias("accuracy")
    )
    by = Window.partitionBy("symbol")
    g = g.withColumns({"weight": 1 / F.col("mae") / F.sum(1 / F.col("mae")).over(by), "best": F.row_number().over(by.orderBy("mae", "model")) == 1})
    return rounded(g, "mae", "accuracy", "weight")


@query(
    f"""{RET}, c AS (SELECT symbol, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe FROM rets WHERE ret IS NOT NULL GROUP BY 1
    ), q AS (SELECT symbol, row_number() OVER ({O}) AS slot, ret FROM rets), p AS (SELECT avg(c) AS rho FROM (SELECT corr(x.ret, y.ret) AS c FROM q x JOIN q y ON x.slot = y.slot AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY x.symbol, y.symbol))
    SELECT count(*) AS instruments, {r("avg(sharpe)", "mean_sharpe")}, {r("any_value(rho)", "rho")}, {r("avg(sharpe) * sqrt(count(*)) * sqrt(1 / (1 + (count(*) - 1) * greatest(0, any_value(rho))))", "ensemble_sharpe")}, {r("sqrt(count(*) / (1 + (count(*) - 1) * greatest(0, any_value(rho))))", "capacity")} FROM c, p"""
)
def ensemble_metrics(spark, sf_dir):
    """What all instruments together come to, given their mean ratio and correlation."""
    from ..operators import relational as REL

    d = W.log_returns(ticks(spark, sf_dir)).withColumn("slot", F.row_number().over(W.ordered())).where("ret IS NOT NULL")
    each = d.groupBy("symbol").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe")).agg(F.count("*").alias("instruments"), F.avg("sharpe").alias("mean_sharpe"))
    one = each.crossJoin(F.broadcast(REL.correlations(d).agg(F.avg("rho").alias("rho"))))  # one row each
    n, shared = F.col("instruments"), 1 + (F.col("instruments") - 1) * F.greatest(F.lit(0.0), F.col("rho"))
    out = one.withColumns({"ensemble_sharpe": F.col("mean_sharpe") * F.sqrt(n) * F.sqrt(1 / shared), "capacity": F.sqrt(n / shared)})
    return rounded(out, "mean_sharpe", "rho", "ensemble_sharpe", "capacity")


@query(
    f"""{with_views("order_log")}, d AS (SELECT account, order_id, ts, CASE WHEN notional > 250000 THEN 'ORDER_SIZE' WHEN event_type = 'P' THEN 'PENDING' END AS reason FROM order_log
    ), w AS (SELECT account % 10 AS desk, avg(CASE WHEN reason IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) OVER v AS rate, count(*) OVER v AS n, reason FROM d WINDOW v AS (PARTITION BY account % 10 ORDER BY ts, order_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT desk, count(*) AS n, {r("max(rate)", "most")}, {r("avg(rate)", "mean")}, count(*) FILTER (n >= 20 AND rate > 0.15) AS degraded, count(*) FILTER (reason = 'ORDER_SIZE') AS order_size, count(*) FILTER (reason = 'PENDING') AS pending FROM w GROUP BY 1"""
)
def rejection_rates(spark, sf_dir):
    """Share of the last 100 orders of each desk that were refused, and for what."""
    o = order_log(spark, sf_dir).withColumns({"desk": F.col("account") % 10, "reason": F.when(F.col("notional") > 250_000, "ORDER_SIZE").when(F.col("event_type") == "P", "PENDING")})
    d = R.rejections(o, ("desk",), ("ts", "order_id"), critical=0.15)
    of = lambda name: F.count(F.when(F.col("reason") == name, 1))
    out = d.groupBy("desk").agg(F.count("*").alias("n"), F.max("rejection_rate").alias("most"), F.avg("rejection_rate").alias("mean"), F.count(F.when(F.col("degraded"), 1)).alias("degraded"), of("ORDER_SIZE").alias("order_size"), of("PENDING").alias("pending"))
    return rounded(out, "most", "mean")


@query(
    f"""{CURVE}, b AS (SELECT symbol, equity, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, order_id DESC, line DESC, pnl DESC) AS back FROM d)
    SELECT symbol, {r("max(equity) FILTER (back = 1) - max(equity) FILTER (back = 2) + 1e-7", "change", 2)} FROM b WHERE back <= 2 GROUP BY 1"""
)
def last_equity_change(spark, sf_dir):
    """Difference of the two newest equity rows (1e-7 keeps amounts in cents off ties)."""
    w = Window.partitionBy("symbol").orderBy(*(F.desc(c) for c in P.TRADE_ORDER))
    d = P.equity_curve(trades(spark, sf_dir), 1_000_000.0).withColumn("back", F.row_number().over(w)).where("back <= 2")
    pick = lambda k: F.max(F.when(F.col("back") == k, F.col("equity")))
    return rounded(d.groupBy("symbol").agg((pick(1) - pick(2) + 1e-7).alias("change")), "change", digits=2)


BPS = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0)


@query(
    f"""{FL}, s AS (SELECT sum(qty * price) AS notional, sum(CASE WHEN side = 'BUY' THEN (arrival_price - price) * qty ELSE (price - arrival_price) * qty END) AS gross FROM fills
    ), c AS (SELECT bps, abs(gross) + notional * 0.0002::DOUBLE - notional * bps / 10000 AS net FROM s, (SELECT unnest({[*BPS]}::DOUBLE[]) AS bps)
    ), n AS (SELECT *, lead(net) OVER (ORDER BY bps) AS after, lead(bps) OVER (ORDER BY bps) AS bps2 FROM c)
    SELECT {r("regr_slope(net, bps)", "elasticity", 2)}, {r("coalesce(arg_min(bps + net / (net - after) * (bps2 - bps), bps) FILTER (net >= 0 AND after < 0), CASE WHEN min(net) > 0 THEN max(bps) * 1.5 ELSE 0 END)", "break_even")} FROM n"""
)
def cost_elasticity(spark, sf_dir):
    """Slope of the net profit over a grid of costs, and where it crosses 0."""
    gained = F.when(F.col("side") == "BUY", F.col("arrival_price") - F.col("price")).otherwise(F.col("price") - F.col("arrival_price")) * F.col("qty")
    s = fills(spark, sf_dir).agg(F.sum(F.col("qty") * F.col("price")).alias("notional"), F.sum(gained).alias("gross"))
    c = s.select(F.explode(F.array(*(F.lit(b) for b in BPS))).alias("bps"), "notional", "gross")
    c = c.select("bps", (F.abs("gross") + F.col("notional") * 0.0002 - F.col("notional") * F.col("bps") / 10_000).alias("net"))
    return rounded(rounded(R.break_even(c), "elasticity", digits=2), "break_even")


@query(
    f"""{RET}, k AS (SELECT symbol, seq % 4 AS regime_id, ret, row_number() OVER (PARTITION BY symbol, seq % 4 ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY symbol, seq % 4) AS n FROM rets WHERE ret IS NOT NULL
    ), g AS (SELECT symbol, regime_id, any_value(n) AS n, var_pop(ret) FILTER (k <= n // 2) AS v1, var_pop(ret) FILTER (k > n // 2) AS v2, avg(ret) FILTER (k <= n // 2) AS m1, avg(ret) FILTER (k > n // 2) AS m2, stddev_pop(ret) AS s FROM k GROUP BY 1, 2 HAVING any_value(n) >= 20
    ), x AS (SELECT *, CASE WHEN v1 > 0 THEN v2 / v1 ELSE 1 END AS q, abs(m2 - m1) / greatest(s, 1e-10) AS z FROM g)
    SELECT symbol, regime_id, n, {r("q", "variance_ratio")}, {r("z", "mean_z")}, q > 0.5 AND q < 2 AND z < 2 AS stationary, CASE WHEN q > 0.5 AND q < 2 AND z < 2 THEN 'STATIONARY' ELSE 'NON-STATIONARY' END AS verdict FROM x"""
)
def stationarity(spark, sf_dir):
    """Whether each regime's returns keep their mean and variance from one half to the other."""
    d = lagged_returns(spark, sf_dir).where("ret IS NOT NULL").withColumn("regime_id", F.col("seq") % 4)
    by = Window.partitionBy("symbol", "regime_id").orderBy("ts", "seq")
    out = R.stationarity(d.select("symbol", "regime_id", F.col("ret").alias("x"), F.row_number().over(by).alias("k")), ("symbol", "regime_id"))
    return rounded(out, "variance_ratio", "mean_z")


@query()
def unit_root_tests(spark, sf_dir):
    """Dickey-Fuller and KPSS tests of each symbol's returns in each price regime; the tests compare them with plain regressions."""
    d = regime_returns(spark, sf_dir)
    return rounded(stationarity_tests(d, ("symbol", "regime_id"), "ret"), "adf", "adf_p", "kpss", "kpss_p")


def regime_returns(spark, sf_dir):
    """Returns of each tick with the price regime before it."""
    d = rolling(ticks(spark, sf_dir), 1, lambda d, keys: W.log_returns(d, keys).withColumn("regime_id", F.lag(F.floor(F.col("price") / 20) % 3).over(W.ordered(keys))))
    return d.where("ret IS NOT NULL").select("symbol", "regime_id", "ts", "seq", "ret")


@query(
    f"""{RET}, v AS (SELECT symbol, volume, ret FROM rets WHERE ret IS NOT NULL), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2::DOUBLE AS x, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2::DOUBLE AS y FROM v)
    SELECT symbol, count(*) AS n, {r("corr(x, y)", "rho")} FROM k GROUP BY 1"""
)
def volume_return_ranks(spark, sf_dir):
    """Rank correlation of volumes and returns; a symbol's ranks come from as many ranges as the session has partitions."""
    d = rolling(ticks(spark, sf_dir), 1, lambda d, keys: W.log_returns(d, keys))
    return rounded(rank_correlation(d, "volume", "ret", ("symbol",)), "rho")


NAIVE = f"""{RET}, e AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS n, ret, lag(ret) OVER ({O}) AS was, avg(ret) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean FROM rets
    ), er AS (SELECT symbol, 'last' AS model, n - 1 AS k, abs(ret - was) AS error FROM e WHERE n > 1 UNION ALL SELECT symbol, 'mean', n - 1, abs(ret - mean) FROM e WHERE n > 1
    ), b AS (SELECT symbol, model, (k - 1) // 50 AS block, error FROM er), m AS (SELECT symbol, model, block, avg(error) AS mean_error FROM b GROUP BY ALL HAVING count(*) = 50
    ), pr AS (SELECT symbol, model, error, block, block + unnest([0, 1]) AS pair FROM b), rk AS (SELECT *, rank() OVER (PARTITION BY symbol, model, pair ORDER BY error) + (count(*) OVER (PARTITION BY symbol, model, pair, error) - 1) / 2::DOUBLE AS k, count(*) OVER (PARTITION BY symbol, model, pair, error)::DOUBLE AS t FROM pr
    ), st AS (SELECT symbol, model, pair AS block, sum(k) FILTER (block = pair) - 50 * 51 / 2::DOUBLE AS u, sum(t * t - 1) AS tie FROM rk GROUP BY ALL HAVING count(*) = 100
    ), z AS (SELECT symbol, model, block, (u - 1250 - 0.5::DOUBLE) / sqrt(2500::DOUBLE / 12 * (101 - tie / (100 * 99))) AS z FROM st
    ), j AS (SELECT m.*, lag(mean_error) OVER w AS before, z FROM m LEFT JOIN z USING (symbol, model, block) WINDOW w AS (PARTITION BY symbol, model ORDER BY block)
    ), d AS (SELECT *, mean_error / before AS ratio, {normal.sql_cumulative('z')} AS c, coalesce(mean_error / before > 1.3 OR 1 - {normal.sql_cumulative('z')} < 0.05, false) AS degraded FROM j
    ), i AS (SELECT *, sum(CASE WHEN degraded THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, model ORDER BY block ROWS UNBOUNDED PRECEDING) AS island FROM d
    ), f AS (SELECT *, degraded AND row_number() OVER (PARTITION BY symbol, model, island, degraded ORDER BY block) % 2 = 1 AS rolled_back FROM i)"""


@query(
    f"""{NAIVE} SELECT symbol, model, block, {r("mean_error", "mean_error", 9)}, {r("ratio", "ratio")}, {r("1 - c", "p")}, degraded, rolled_back, last_value(CASE WHEN NOT rolled_back THEN block END IGNORE NULLS) OVER (PARTITION BY symbol, model ORDER BY block ROWS UNBOUNDED PRECEDING) AS version FROM f"""
)
def model_rollbacks(spark, sf_dir):
    """Versions of two naive forecasts of the next return, the last return and the mean of 20, by blocks of 50 errors."""
    d = rolling(ticks(spark, sf_dir), 23, lambda d, keys: naive_forecasts(d, keys)).where("n > 2")
    errors = d.select("symbol", (F.col("n") - 2).alias("k"), F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.abs(F.col("ret") - F.col(m)).alias("error")) for m in ("last", "mean")))).alias("e"))
    out = rollbacks(errors.select("symbol", "e.model", "k", "e.error"), ("symbol", "model"))
    return rounded(rounded(out, "mean_error", digits=9), "ratio", "p")


def naive_forecasts(d, keys):
    d = W.log_returns(d, keys)
    return d.withColumns({"last": F.lag("ret").over(W.ordered(keys)), "mean": F.avg("ret").over(W.before(20, keys))})


@query(
    f"""WITH RECURSIVE {RET[5:]}, e AS (SELECT symbol, seq, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n, ret, lag(ret) OVER ({O}) AS last, avg(ret) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean FROM rets
    ), f AS (SELECT symbol, seq, n - 2 AS n, ret, last, mean, 0.0::DOUBLE AS none FROM e WHERE n > 2
    ), a AS (SELECT *, count(*) OVER w AS c, avg(abs(ret - last)) OVER w AS a, avg(abs(ret - mean)) OVER w AS b, avg(abs(ret)) OVER w AS d FROM f WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)
    ), x AS (SELECT *, n > 50 AS learned, 1 / a / (1 / a + 1 / b + 1 / d) AS wa, 1 / b / (1 / a + 1 / b + 1 / d) AS wb, 1 / d / (1 / a + 1 / b + 1 / d) AS wd FROM a
    ), s AS (
      SELECT symbol, seq, n, last, mean, learned, 1 / 3::DOUBLE AS u, 1 / 3::DOUBLE AS v, 1 / 3::DOUBLE AS z FROM x WHERE n = 1
      UNION ALL
      SELECT x.symbol, x.seq, x.n, x.last, x.mean, x.learned, CASE WHEN x.learned THEN 0.98::DOUBLE * u + (1 - 0.98::DOUBLE) * wa ELSE u END, CASE WHEN x.learned THEN 0.98::DOUBLE * v + (1 - 0.98::DOUBLE) * wb ELSE v END, CASE WHEN x.learned THEN 0.98::DOUBLE * z + (1 - 0.98::DOUBLE) * wd ELSE z END FROM s JOIN x ON x.symbol = s.symbol AND x.n = s.n + 1)
    SELECT symbol, seq, {r("u", "w_last")}, {r("v", "w_mean")}, {r("z", "w_none")}, {r("CASE WHEN learned THEN (u * last + v * mean) / (u + v + z) ELSE (last + mean) / 3 END", "blend")}, {r("sqrt(((last - (last + mean) / 3) ** 2 + (mean - (last + mean) / 3) ** 2 + ((last + mean) / 3) ** 2) / 3)", "disagreement")} FROM s"""
)
def blended_forecasts(spark, sf_dir):
    """Three naive forecasts of the next return, the last one, the mean of 20 and none at all, weighed by their errors."""
    d = rolling(ticks(spark, sf_dir), 23, lambda d, keys: naive_forecasts(d, keys)).where("n > 2").drop("n").withColumn("none", F.lit(0.0))
    cols = ("w_last", "w_mean", "w_none", "blend", "disagreement")
    return rounded(blended(d, ("last", "mean", "none"), "ret"), *cols).select("symbol", "seq", *cols)


DAYS = f"{TR}, dd AS (SELECT CAST(ts AS DATE) AS day, sum(pnl) AS pnl FROM trades GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY day) AS i, pnl FROM dd)"


def _versus(name: str, source: str) -> str:
    return f"""(WITH b AS ({source}), q AS (SELECT i, pnl, sum(pnl) OVER (ORDER BY i) AS c FROM s), qa AS (SELECT sum(pnl) AS total, max(f) AS fall FROM (SELECT pnl, max(c) OVER (ORDER BY i) - c AS f FROM q)),
      p AS (SELECT i, pnl, sum(pnl) OVER (ORDER BY i) AS c FROM b), pa AS (SELECT sum(pnl) AS total, max(f) AS fall FROM (SELECT pnl, max(c) OVER (ORDER BY i) - c AS f FROM p)),
      j AS (SELECT s.pnl - b.pnl AS d, sum(s.pnl) OVER (ORDER BY i) > sum(b.pnl) OVER (ORDER BY i) AS ahead FROM s JOIN b USING (i))
      SELECT '{name}' AS benchmark_name, any_value(qa.total) AS strategy, any_value(qa.fall) AS strategy_fall, any_value(pa.total) AS benchmark, any_value(pa.fall) AS benchmark_fall, CASE WHEN count(*) > 1 AND stddev_pop(d) > 1e-10 THEN avg(d) / stddev_pop(d) ELSE 0 END AS information_ratio, avg(ahead::INT) AS outperformed, any_value(qa.total) - any_value(pa.total) AS excess FROM j, qa, pa)"""


RANDOM = f"SELECT i, CASE WHEN {P.SQL_DRAW.format(t='0', i='i', s=11)} % 2 = 0 THEN pnl ELSE -pnl END AS pnl FROM s"


@query(
    f"""{DAYS}, u AS ({_versus("inverse", "SELECT i, -pnl AS pnl FROM s")} UNION ALL {_versus("random", RANDOM)})
    SELECT benchmark_name, {r("strategy", "strategy", 2)}, {r("strategy_fall", "strategy_fall", 2)}, {r("benchmark", "benchmark", 2)}, {r("benchmark_fall", "benchmark_fall", 2)}, {r("excess", "excess", 2)}, {r("information_ratio", "information_ratio")}, {r("outperformed", "outperformed")} FROM u"""
)
def benchmarks(spark, sf_dir):
    """Daily profit against its inverse and against random directions."""
    daily = trades(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    s = daily.select(F.row_number().over(Window.orderBy("day")).cast("long").alias("i"), "pnl")  # as many rows as days
    others = {"inverse": s.select("i", (-F.col("pnl")).alias("pnl")), "random": s.select("i", F.when(P.draw(F.lit(0).cast("long"), F.col("i"), 11) % 2 == 0, F.col("pnl")).otherwise(-F.col("pnl")).alias("pnl"))}
    rows = [R.versus(s, b).withColumn("benchmark_name", F.lit(name)) for name, b in others.items()]
    out = rows[0].unionByName(rows[1])
    return rounded(rounded(out, "strategy", "strategy_fall", "benchmark", "benchmark_fall", "excess", digits=2), "information_ratio", "outperformed")


@query(f"{T}, c AS (SELECT count(*) // 4 AS size FROM ticks), f AS (SELECT unnest(range(3)) AS fold) SELECT CAST(fold AS INTEGER) AS fold, (fold + 1) * size AS train_last, (fold + 1) * size + 1 AS test_first, (fold + 2) * size AS test_last FROM c, f")
def growing_folds(spark, sf_dir):
    """Three folds that train on all that comes before their test."""
    return R.growing_folds(ticks(spark, sf_dir).agg(F.count("*").alias("n")))


HALVES = f"""{TR}, o AS (SELECT *, ntile(4) OVER (PARTITION BY symbol ORDER BY ts, order_id, line, pnl) AS q FROM trades
), g AS (SELECT symbol, count(*) FILTER (q = 4) AS trades, avg(pnl) FILTER (q < 4) / stddev_samp(pnl) FILTER (q < 4) AS inside, avg(pnl) FILTER (q = 4) / stddev_samp(pnl) FILTER (q = 4) AS outside, sum(pnl) FILTER (q = 4) AS pnl,
  avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (q = 4) AS win_rate, avg(pnl) FILTER (q = 4 AND pnl > 0) / -avg(pnl) FILTER (q = 4 AND pnl < 0) AS payoff, skewness(pnl) FILTER (q = 4) AS sk FROM o GROUP BY 1
), e AS (SELECT *, CASE WHEN abs(inside) > 0.01 THEN CASE WHEN abs(outside) > 0.01 THEN abs(inside / outside) ELSE 'inf'::DOUBLE END ELSE CASE WHEN abs(outside) < 0.01 THEN 1 ELSE 'inf'::DOUBLE END END AS degradation, {normal.sql_cumulative("(outside * sqrt(trades))")} > 0.95 AS significant FROM g)"""


def _halves(spark, sf_dir):
    """Each symbol's trades in quarters: three inside the sample, the newest outside."""
    q = F.ntile(4).over(Window.partitionBy("symbol").orderBy(*P.TRADE_ORDER))
    d = trades(spark, sf_dir).withColumn("q", q)
    out, pnl = F.col("q") == 4, F.col("pnl")
    ratio = lambda which: F.avg(F.when(which, pnl)) / F.stddev_samp(F.when(which, pnl))
    g = d.groupBy("symbol").agg(
        F.count(F.when(out, 1)).alias("trades"), ratio(~out).alias("inside"), ratio(out).alias("outside"), F.sum(F.when(out, pnl)).alias("pnl"), F.avg(F.when(out, F.when(pnl > 0, 1.0).otherwise(0.0))).alias("win_rate"),
        (F.avg(F.when(out & (pnl > 0), pnl)) / -F.avg(F.when(out & (pnl < 0), pnl))).alias("payoff"),
    )
    return g.withColumns({"degradation": R.degradation(F.col("inside"), F.col("outside")), "significant": normal.cumulative(F.col("outside") * F.sqrt("trades")) > 0.95})


@query(
    f"""{HALVES} SELECT symbol, trades, {r("inside", "inside")}, {r("outside", "outside")}, CASE WHEN isinf(degradation) THEN -1 ELSE round(degradation, 6) END AS degradation, significant,
    CASE WHEN outside > 0 AND degradation < 1.5 AND trades >= 20 AND significant THEN 'CONFIRMED' WHEN trades < 20 THEN 'TOO_FEW_TRADES' WHEN NOT significant THEN 'NOT_SIGNIFICANT' WHEN outside > 0 AND degradation >= 1.5 THEN 'POSSIBLY_OVERFIT' ELSE 'NO_ALPHA' END AS verdict FROM e"""
)
def out_of_sample(spark, sf_dir):
    """What each symbol's last quarter of trades says of the three before; -1 stands for an infinite degradation."""
    d = _halves(spark, sf_dir)
    v = R.verdict(F.col("outside"), F.col("degradation"), F.col("trades"), F.col("significant"), F.lit(0.0))
    d = d.select("symbol", "trades", "inside", "outside", F.when(F.col("degradation") == float("inf"), -1.0).otherwise(F.round("degradation", 6)).alias("degradation"), "significant", v.alias("verdict"))
    return rounded(d, "inside", "outside")


@query(
    f"""{HALVES} SELECT symbol, trades, {r("win_rate", "win_rate")}, {r("payoff", "payoff")}, {r("win_rate - (1 - win_rate) / payoff", "kelly")}, {r("pnl / 1e6", "return_share", 9)},
    CASE WHEN CASE WHEN abs(outside) > 0.01 THEN abs(inside / outside) WHEN abs(inside) > 0.1 THEN 'inf'::DOUBLE ELSE 1 END <= 1.5 THEN 'good' WHEN CASE WHEN abs(outside) > 0.01 THEN abs(inside / outside) WHEN abs(inside) > 0.1 THEN 'inf'::DOUBLE ELSE 1 END <= 3 THEN 'moderate' ELSE 'overfit' END AS assessment FROM e"""
)
def trial_diagnostics(spark, sf_dir):
    """Tail, return and overfitting of each symbol's last quarter of trades."""
    ratio = F.when(F.abs("outside") > 0.01, F.abs(F.col("inside") / F.col("outside"))).when(F.abs("inside") > 0.1, float("inf")).otherwise(1.0)
    d = _halves(spark, sf_dir).select(
        "symbol", "trades", "win_rate", "payoff", (F.col("win_rate") - (1 - F.col("win_rate")) / F.col("payoff")).alias("kelly"), (F.col("pnl") / 1e6).alias("return_share"), F.when(ratio <= 1.5, "good").when(ratio <= 3.0, "moderate").otherwise("overfit").alias("assessment")
    )
    return rounded(rounded(d, "win_rate", "payoff", "kelly"), "return_share", digits=9)


@query(
    f"""{TR}, b AS (SELECT symbol, order_id, line, pnl, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, order_id, line) AS best, row_number() OVER (PARTITION BY symbol ORDER BY pnl, order_id, line) AS worst FROM trades)
    SELECT symbol, 'best' AS side, CAST(best AS INTEGER) AS place, order_id, line, {r("pnl", "pnl", 4)} FROM b WHERE best <= 5 UNION ALL SELECT symbol, 'worst', CAST(worst AS INTEGER), order_id, line, {r("pnl", "pnl", 4)} FROM b WHERE worst <= 5"""
)
def extreme_trades(spark, sf_dir):
    """The five best and the five worst trades of each symbol."""
    t = trades(spark, sf_dir).select("symbol", "order_id", "line", "pnl")
    place = lambda *by: F.row_number().over(Window.partitionBy("symbol").orderBy(*by, "order_id", "line"))
    t = t.withColumns({"b": place(F.desc("pnl")), "w": place("pnl")})
    best, worst = (t.where(f"{c} <= 5").select("symbol", F.lit(side).alias("side"), F.col(c).alias("place"), "order_id", "line", "pnl") for c, side in (("b", "best"), ("w", "worst")))
    return rounded(best.union(worst), "pnl", digits=4)


@query(f"{T}, n AS (SELECT symbol, seq, price, row_number() OVER ({O}) AS n FROM ticks) SELECT symbol, seq, price FROM n WHERE n % 25 = 0")
def systematic_sample(spark, sf_dir):
    """Every 25th tick of a symbol: a sampling operator."""
    return numbered(ticks(spark, sf_dir)).where("n % 25 = 0").select("symbol", "seq", "price")


@query(
    f"""{with_views("order_log", "fills")}, e AS (SELECT account % 20 AS desk, order_id, 0 AS step, 'SUBMITTED' AS kind, 1.0::DOUBLE AS signed FROM order_log UNION ALL SELECT account % 20, order_id, 1, CASE WHEN event_type = 'F' THEN 'FILLED' WHEN event_type = 'P' THEN 'CANCELLED' END, 1.0::DOUBLE FROM order_log WHERE event_type IN ('F', 'P')
    ), s AS (SELECT desk, order_id, step, sum(CASE WHEN kind = 'FILLED' THEN signed ELSE 0 END) OVER w AS position, sum(CASE WHEN kind = 'SUBMITTED' THEN signed ELSE -signed END) OVER w AS pending FROM e WINDOW w AS (PARTITION BY desk ORDER BY order_id, step ROWS UNBOUNDED PRECEDING))
    SELECT desk, arg_max(position, (order_id, step)) AS position, arg_max(pending, (order_id, step)) AS pending, max(pending) AS most_pending FROM s GROUP BY 1"""
)
def pending_orders(spark, sf_dir):
    """Filled and pending orders of each desk in the end, and the most that were pending."""
    o = order_log(spark, sf_dir).withColumn("desk", F.col("account") % 20)
    sent = o.select("desk", "order_id", F.lit(0).alias("step"), F.lit("SUBMITTED").alias("kind"), F.lit(1.0).alias("signed"))
    done = o.where("event_type IN ('F', 'P')").select("desk", "order_id", F.lit(1).alias("step"), F.when(F.col("event_type") == "F", "FILLED").otherwise("CANCELLED").alias("kind"), F.lit(1.0).alias("signed"))
    d = R.position_states(sent.union(done), ("desk",), ("order_id", "step"))
    at = F.struct("order_id", "step")
    return d.groupBy("desk").agg(F.max_by("position", at).alias("position"), F.max_by("pending", at).alias("pending"), F.max("pending").alias("most_pending"))


@query(
    f"""{RET}, v AS (SELECT symbol, ret, volume > 50 AS heavy FROM rets WHERE ret IS NOT NULL), k AS (SELECT symbol, heavy, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2::DOUBLE AS k, count(*) OVER (PARTITION BY symbol, ret)::DOUBLE AS t FROM v
    ), g AS (SELECT symbol, count(*) FILTER (heavy) AS n1, count(*) FILTER (NOT heavy) AS n2, sum(k) FILTER (heavy) AS r1, sum(t * t - 1) AS tie FROM k GROUP BY 1
    ), u AS (SELECT *, r1 - n1::DOUBLE * (n1 + 1) / 2 AS u, (n1 + n2)::DOUBLE AS n FROM g), z AS (SELECT *, greatest(0, abs(u - n1::DOUBLE * n2 / 2) - 0.5) / sqrt(n1::DOUBLE * n2 / 12 * (n + 1 - tie / (n * (n - 1)))) AS z FROM u)
    SELECT symbol, n1, n2, {r("u", "u", 1)}, {r(f"2 * (1 - {normal.sql_cumulative('z')})", "p")} FROM z"""
)
def rank_sum_test(spark, sf_dir):
    """Whether returns on heavy volume rank unlike the others."""
    d = lagged_returns(spark, sf_dir).where("ret IS NOT NULL").withColumn("heavy", F.col("volume") > 50)
    return rounded(rounded(rank_sum(d, "ret", "heavy", ("symbol",)).drop("method"), "u", digits=1), "p")


@query()
def predictive_regimes(spark, sf_dir):
    """Regimes whose next returns differ from 0, others banned; p-values are compared with known ones in the tests."""
    w = W.ordered()
    d = W.log_returns(ticks(spark, sf_dir)).withColumn("regime_id", F.lag(F.floor(F.col("price") / 20) % 3).over(w)).where("ret IS NOT NULL")
    return rounded(R.predictive_regimes(d.select("symbol", "regime_id", "ret", F.struct("ts", "seq").alias("at"))), "t", "p")


def _section(name: str, pairs: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS section, '{k}' AS metric, {e}::DOUBLE AS value FROM {source}" for k, e in pairs.items())


SHEET = {
    "summary": {"trades": "count(*)", "total_pnl": "sum(pnl)", "win_rate": "avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)", "expectancy": "avg(pnl)", "profit_factor": "sum(greatest(pnl, 0)) / -sum(least(pnl, 0))"},
    "risk": {"sharpe": "avg(pnl) / stddev_samp(pnl)", "sortino": "avg(pnl) / stddev_samp(CASE WHEN pnl < 0 THEN pnl END)", "omega": "sum(greatest(pnl, 0)) / -sum(least(pnl, 0))", "kurt": "kurtosis_pop(pnl)", "worst": "min(pnl)"},
    "trades": {"avg_hold": "avg(hold)", "median_hold": "quantile_cont(hold, 0.5)", "avg_mae": "avg(mae_pct)", "avg_mfe": "avg(mfe_pct)", "best": "max(pnl)"},
}


@query(f"{TR}, u AS ({' UNION ALL '.join(_section(name, pairs, 'trades') for name, pairs in SHEET.items())}) SELECT section, metric, {r('value', 'value', 4)} FROM u")
def tearsheet(spark, sf_dir):
    """The sections of a report on all trades, a row for each figure."""
    pnl = F.col("pnl")
    gains, losses = F.sum(F.greatest(pnl, F.lit(0.0))), -F.sum(F.least(pnl, F.lit(0.0)))
    figures = {
        "summary": {"trades": F.count("*").cast("double"), "total_pnl": F.sum(pnl), "win_rate": F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)), "expectancy": F.avg(pnl), "profit_factor": gains / losses},
        "risk": {"sharpe": F.avg(pnl) / F.stddev_samp(pnl), "sortino": F.avg(pnl) / F.stddev_samp(F.when(pnl < 0, pnl)), "omega": gains / losses, "kurt": F.kurtosis(pnl), "worst": F.min(pnl)},
        "trades": {"avg_hold": F.avg("hold"), "median_hold": F.percentile("hold", F.lit(0.5)), "avg_mae": F.avg("mae_pct"), "avg_mfe": F.avg("mfe_pct"), "best": F.max(pnl)},
    }
    one = trades(spark, sf_dir).agg(*(c.alias(f"{s}|{m}") for s, part in figures.items() for m, c in part.items()))
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"`{s}|{m}`").alias("value")) for s, part in figures.items() for m in part))
    return rounded(one.select(F.inline(rows)), "value", digits=4)


@query(
    f"""{with_views("fills")}, g AS (SELECT symbol, side, count(*) AS n, sum(fees) AS fees FROM fills GROUP BY 1, 2), m AS (SELECT symbol, map_from_entries(list((side, n))) AS by_side FROM g GROUP BY 1)
    SELECT symbol, coalesce(by_side['BUY'], 0)::BIGINT AS bought, coalesce(by_side['SELL'], 0)::BIGINT AS sold, coalesce(by_side['HOLD'], 0)::BIGINT AS held FROM m"""
)
def side_counts(spark, sf_dir):
    """Counts by side as a map, read with a default for sides that are not there."""
    g = fills(spark, sf_dir).groupBy("symbol", "side").agg(F.count("*").alias("n"))
    m = g.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("side", "n"))).alias("by_side"))  # two entries at most
    get = lambda k: F.coalesce(F.try_element_at("by_side", F.lit(k)), F.lit(0)).cast("long")
    return m.select("symbol", get("BUY").alias("bought"), get("SELL").alias("sold"), get("HOLD").alias("held"))


@query(
    f"""{RET}, k AS (SELECT symbol, seq, ts, rank() OVER (PARTITION BY symbol ORDER BY ret) AS one, ret, -lag(ret) OVER ({O}) AS p FROM rets
    ), l AS (SELECT symbol, seq, list(p) OVER w AS ps, list(ret) OVER w AS rs, count(*) OVER w AS n FROM k WHERE p IS NOT NULL AND ret IS NOT NULL WINDOW w AS {last(20)}
    ), u AS (SELECT symbol, seq, n, ps, rs, unnest(range(1, n + 1)) AS i FROM l
    ), q AS (SELECT symbol, seq, n, len(list_filter(ps, lambda x: x < ps[i])) + (len(list_filter(ps, lambda x: x = ps[i])) + 1) / 2::DOUBLE AS rp, len(list_filter(rs, lambda x: x < rs[i])) + (len(list_filter(rs, lambda x: x = rs[i])) + 1) / 2::DOUBLE AS rr FROM u)
    SELECT symbol, seq, {r("CASE WHEN any_value(n) < 10 THEN 0 ELSE coalesce(corr(rp, rr), 0) END", "ic_20")} FROM q GROUP BY 1, 2"""
)
def rolling_ic(spark, sf_dir):
    """Rank correlation of the last 20 reversal predictions with what came."""
    w = W.ordered()
    d = W.log_returns(ticks(spark, sf_dir)).withColumn("p", -F.lag("ret").over(w)).where("p IS NOT NULL AND ret IS NOT NULL")
    out = rolling(d, 20, lambda rows, keys: W.rolling_rank_correlation(rows, "p", "ret", keys=keys))
    return rounded(out, "ic_20").select("symbol", "seq", "ic_20")


@query(
    f"""{RET}, w AS (SELECT symbol, seq, coalesce(list(ret) FILTER (ret IS NOT NULL) OVER {last(150)}, []) AS l, avg(ret) OVER {last(150)} AS m FROM rets
    ), d AS (SELECT symbol, seq, list_transform(l, lambda x: x - m) AS d FROM w)
    SELECT symbol, seq, {r("CASE WHEN len(d) > 2 AND list_dot_product(d, d) > 1e-20 THEN list_dot_product(d[1:len(d) - 1], d[2:]) / list_dot_product(d, d) ELSE 0 END", "persistence")} FROM d"""
)
def window_persistence(spark, sf_dir):
    """Lag-one autocorrelation of the last 150 returns."""
    out = rolling(ticks(spark, sf_dir), 151, lambda d, keys: W.persistence(W.log_returns(d, keys), keys=keys))
    return rounded(out, "persistence").select("symbol", "seq", "persistence")


@query("SELECT count(*) AS n, count(*) FILTER (volume > 0 OR volume IS NULL) AS kept FROM (SELECT CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS volume FROM events WHERE value > 0)")
def tradable_ticks(spark, sf_dir):
    """Ticks that a strategy sees: with volume, or with none told."""
    t = ticks(spark, sf_dir).withColumn("volume", F.when(F.col("seq") % 11 != 0, F.when(F.col("seq") % 7 == 0, 0.0).otherwise(1.0)))
    kept = t.where("volume IS NULL OR volume > 0")
    return t.agg(F.count("*").alias("n")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"))))  # one row each
