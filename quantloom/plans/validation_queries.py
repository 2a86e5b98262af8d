"""Queries of resampled intervals, validation and walk-forward reports, top features, exit journals, capped alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import default_parallelism
from ..functions import normal
from ..operators import monitoring as M
from ..operators import performance as P
from ..operators import portfolio as PF
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import trades as X
from ..operators import validation as V
from ..operators import windows as W
from ..operators.density import kernel_draws
from ..operators.tiles import rolling
from ..sources.views import ticks, trades, with_views
from .common import ORACLE_SQL, query, r, rounded
from .density_queries import WIN, windows
from .model_queries import QUALITY, _checked
from .performance_queries import NUM, _daily
from .report_queries import HALVES, _halves
from .tick_queries import RET, O

T, TR = with_views("ticks"), with_views("trades")

SAMPLES = f"""{NUM}, c AS (SELECT count(*) AS n FROM v), k AS (SELECT t.trial, {P.SQL_DRAW.format(t="t.trial", i="v.i", s=42)} % n AS i FROM v, c, (SELECT unnest(range(5000)) AS trial) t
), m AS (SELECT trial, sum(x) AS total_return, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-10 THEN avg(x) / stddev_pop(x) ELSE 0 END AS sharpe FROM k JOIN v USING (i) GROUP BY 1
), l AS (UNPIVOT (SELECT total_return, mean, sharpe FROM m) ON total_return, mean, sharpe INTO NAME statistic VALUE value
), b AS (SELECT statistic, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM l GROUP BY 1
), s AS (SELECT sum(x) AS total_return, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-10 THEN avg(x) / stddev_pop(x) ELSE 0 END AS sharpe, count(*) AS n, coalesce(sum(-x) FILTER (x < 0), 0) AS lost FROM v
), e AS (UNPIVOT (SELECT total_return, mean, sharpe FROM s) ON total_return, mean, sharpe INTO NAME statistic VALUE estimate)"""


@query(f"""{SAMPLES} SELECT statistic, {r("estimate", "estimate", 3)}, {r("low", "low", 3)}, {r("high", "high", 3)}, low > 0 OR high < 0 AS significant FROM e JOIN b USING (statistic)""")
def resampled_intervals(spark, sf_dir):
    """Intervals of the sum, the mean and the Sharpe ratio of daily profit from 5000 samples."""
    return rounded(V.intervals(_daily(spark, sf_dir)), "estimate", "low", "high", digits=3)


REPORT = {
    ("summary", "trades"): "n", ("summary", "total_return"): "total_return", ("summary", "sharpe"): "sharpe", ("bootstrap", "low"): "low", ("bootstrap", "high"): "high", ("bootstrap", "significant"): "(low > 0 OR high < 0)::INT",
    ("permutation", "p_value"): "p", ("permutation", "significant"): "(p < 0.05)::INT", ("cost", "1x"): "total_return", ("cost", "2x"): "total_return - lost", ("cost", "5x"): "total_return - 4 * lost", ("cost", "10x"): "total_return - 9 * lost",
    ("verdict", "significant"): "(n >= 5 AND (low > 0 OR high < 0) AND p < 0.05)::INT",
}


@query(
    f"""{SAMPLES}, f AS (SELECT t.trial, avg(CASE WHEN {P.SQL_DRAW.format(t="t.trial", i="v.i", s=7)} % 2 = 0 THEN x ELSE -x END) AS mean FROM v, (SELECT unnest(range(5000)) AS trial) t GROUP BY 1
    ), p AS (SELECT avg(CASE WHEN abs(f.mean) >= abs(s.mean) THEN 1.0::DOUBLE ELSE 0 END) AS p FROM f, s), j AS (SELECT s.*, low, high, p FROM s, p, b WHERE statistic = 'total_return')
    """ + " UNION ALL ".join(f"SELECT '{a}' AS section, '{b}' AS metric, {r(f'({e})::DOUBLE', 'value', 3)} FROM j" for (a, b), e in REPORT.items())
)
def validation_report(spark, sf_dir):
    """What resampling, sign flips and higher costs say of daily profit."""
    return rounded(V.validation_report(_daily(spark, sf_dir)), "value", digits=3)


def _fold_sql(i: int) -> str:
    return "n" if i == 5 else f"floor(n * {0.5 + 0.1 * i}::DOUBLE + 1e-9)"


FOLDS = f"""{TR}, wo AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY ts, order_id, line, pnl) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM trades
), fo AS (SELECT unnest(range(5)) AS fold), wg AS (SELECT symbol, fold, CASE fold {" ".join(f"WHEN {i} THEN {_fold_sql(i)}" for i in range(5))} END AS a, CASE fold {" ".join(f"WHEN {i} THEN {_fold_sql(i + 1)}" for i in range(5))} END AS b, k, pnl FROM wo, fo WHERE n >= 100
), ww AS (SELECT symbol, fold, count(*) FILTER (k <= a) AS train_n, count(*) FILTER (k > a AND k <= b) AS test_n, avg(pnl) FILTER (k <= a) / stddev_samp(pnl) FILTER (k <= a) AS train_sharpe, avg(pnl) FILTER (k > a AND k <= b) / stddev_samp(pnl) FILTER (k > a AND k <= b) AS test_sharpe FROM wg GROUP BY 1, 2
), wf AS (SELECT *, CASE WHEN abs(test_sharpe) > 0.01 THEN abs(train_sharpe / test_sharpe) WHEN abs(train_sharpe) > 0.1 THEN 'inf'::DOUBLE ELSE 1 END AS overfit FROM ww)"""


def _folds(spark, sf_dir):
    return V.walk_forward_report(trades(spark, sf_dir), ("symbol",), P.TRADE_ORDER)


@query(f"""{FOLDS} SELECT symbol, fold, train_n, test_n, {r("train_sharpe", "train_sharpe")}, {r("test_sharpe", "test_sharpe")}, CASE WHEN isinf(overfit) THEN -1 ELSE round(overfit, 4) END AS overfit FROM wf""")
def walk_forward_report(spark, sf_dir):
    """Sharpe ratios of each symbol's trades in and out of five growing folds; -1 stands for an infinite ratio of the two."""
    out = rounded(_folds(spark, sf_dir), "train_sharpe", "test_sharpe").withColumn("fold", F.col("fold").cast("long"))
    return out.withColumn("overfit", F.when(F.col("overfit") == float("inf"), -1.0).otherwise(F.round("overfit", 4)))


@query(
    f"""{FOLDS}, pb AS (SELECT symbol, avg(test_sharpe) AS mean_test_sharpe, coalesce(avg(overfit) FILTER (NOT isinf(overfit)), 0) AS mean_overfit, CASE WHEN count(*) >= 4 THEN avg(CASE WHEN overfit > 2 OR test_sharpe < 0 THEN 1.0::DOUBLE ELSE 0 END) ELSE 0 END AS pbo FROM wf GROUP BY 1
    ), {HALVES[len(TR) + 2:]} SELECT symbol, {r("mean_test_sharpe", "mean_test_sharpe")}, {r("mean_overfit", "mean_overfit", 3)}, {r("pbo", "pbo")}, significant,
    CASE WHEN outside > 0 AND degradation < 1.5 AND trades >= 20 AND significant AND pbo <= 0.5 THEN 'CONFIRMED' WHEN trades < 20 THEN 'TOO_FEW_TRADES' WHEN NOT significant THEN 'NOT_SIGNIFICANT' WHEN pbo > 0.5 THEN 'OVERFIT' WHEN outside > 0 AND degradation >= 1.5 THEN 'POSSIBLY_OVERFIT' ELSE 'NO_ALPHA' END AS verdict FROM e JOIN pb USING (symbol)"""
)
def out_of_sample_verdicts(spark, sf_dir):
    """The verdict on each symbol's held-out trades with the overfitting probability of its own folds."""
    d = _halves(spark, sf_dir).join(V.overfit_share(_folds(spark, sf_dir), ("symbol",)), "symbol")
    v = R.verdict(F.col("outside"), F.col("degradation"), F.col("trades"), F.col("significant"), F.col("pbo"))
    return rounded(rounded(d.select("symbol", "mean_test_sharpe", "mean_overfit", "pbo", "significant", v.alias("verdict")), "mean_test_sharpe", "pbo"), "mean_overfit", digits=3)


@query(
    f"""{TR}, s AS (SELECT symbol, avg(pnl) / stddev_samp(pnl) AS b, avg(pnl - 10) / stddev_samp(pnl) AS x FROM trades GROUP BY 1
    ), c AS (SELECT symbol, CASE WHEN abs(x - b) / greatest(abs(b), 1e-10) < 0.1 THEN 'robust' WHEN abs(x - b) / greatest(abs(b), 1e-10) < 0.5 THEN 'sensitive' ELSE 'unstable' END AS class FROM s)
    SELECT class, count(*) AS n, array_to_string(list_sort(list(symbol)), ',') AS symbols FROM c GROUP BY 1"""
)
def sensitivity_classes(spark, sf_dir):
    """The symbols of each class of sensitivity to ten more units of cost on each trade."""
    s = trades(spark, sf_dir).groupBy("symbol").agg((F.avg("pnl") / F.stddev_samp("pnl")).alias("b"), (F.avg(F.col("pnl") - 10) / F.stddev_samp("pnl")).alias("x"))
    c = s.select("symbol", M.sensitivity(F.col("b"), F.col("x")).alias("class"))
    return c.groupBy("class").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("symbols"))


WEIGHED = ("mu", "sigma", "skew", "kurt", "ofi_z", "mom_50", "mom_200", "mean_rev", "slope", "kyle", "toxicity", "intensity")


@query(
    f"""WITH f AS ({ORACLE_SQL["feature_table"]}), {T[5:]}, n AS (SELECT symbol, seq, lead(price) OVER ({O}) - price AS target FROM ticks), g AS (SELECT symbol, {", ".join(f"coalesce(CASE WHEN isnan(corr({c}, target)) THEN 0 ELSE corr({c}, target) END, 0) AS {c}" for c in WEIGHED)} FROM f JOIN n USING (symbol, seq) GROUP BY 1
    ), l AS (UNPIVOT g ON {", ".join(WEIGHED)} INTO NAME feature VALUE weight), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(weight), 9) DESC, feature) AS rank FROM l)
    SELECT symbol, CAST(rank AS INTEGER) AS rank, feature, {r("weight", "weight", 5)} FROM k WHERE rank <= 5"""
)
def top_features(spark, sf_dir):
    """The five features that weigh most on the next move of each symbol."""

    def features(d, keys):
        d = W.moments(W.log_returns(d, keys), keys=keys)
        d = W.ofi_zscore(W.order_flow_imbalance(d, keys), keys=keys)
        d = W.mean_reversion(W.momentum(d, keys), keys=keys)
        d = d.withColumn("target", F.lead("price").over(W.ordered(keys)) - F.col("price"))
        return W.flow(W.kyle_lambda(W.book_slope(d), keys=keys), keys=keys)

    rows = rounded(rolling(ticks(spark, sf_dir), 202, features, lookahead=1, tasks=default_parallelism(spark)), *WEIGHED)
    return rounded(V.top_features(rows, WEIGHED, "target", ("symbol",)), "weight", digits=5).select("symbol", "rank", "feature", "weight")


@query(f"""{QUALITY}, nb AS (SELECT symbol, seq, issue, severity, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC, CASE issue WHEN 'TICK_GAP' THEN 0 WHEN 'CROSSED_MARKET' THEN 2 WHEN 'PRICE_JUMP' THEN 3 WHEN 'ZERO_VOLUME' THEN 4 ELSE 5 END DESC) AS back FROM i) SELECT symbol, seq, issue, severity FROM nb WHERE back <= 50""")
def recent_quality_issues(spark, sf_dir):
    """The newest fifty issues of each symbol."""
    return Q.recent_issues(_checked(spark, sf_dir)).select("symbol", "seq", "issue", "severity")


@query(
    f"""{T}, m AS (SELECT *, row_number() OVER ({O}) AS k, CAST(floor(price / 20) AS BIGINT) % 3 AS regime FROM ticks), l AS (SELECT *, lag(regime) OVER ({O}) AS was FROM m
    ), e AS (SELECT symbol, k AS ek, price AS p0, CASE WHEN regime > was THEN 'BUY' ELSE 'SELL' END AS side FROM l WHERE regime <> was
    ), p AS (SELECT e.symbol, ek, side, m.k, m.k - ek AS age, price, p0, CASE WHEN side = 'BUY' THEN price / p0 - 1 ELSE 1 - price / p0 END AS ret FROM e JOIN m ON m.symbol = e.symbol AND m.k BETWEEN ek + 1 AND ek + 80
    ), q AS (SELECT *, greatest(0, max(ret) OVER w) AS best, least(0, min(ret) OVER w) AS worst, max(price) OVER w AS high, min(price) OVER w AS low, greatest(p0, max(price) OVER w) AS pk, least(p0, min(price) OVER w) AS tr FROM p WINDOW w AS (PARTITION BY symbol, ek ORDER BY k)
    ), d AS (SELECT *, CASE WHEN side = 'BUY' THEN (pk - price) / pk ELSE (price - tr) / tr END AS fall FROM q
    ), x AS (SELECT *, CASE WHEN ret <= -0.5 THEN 'STOP_LOSS' WHEN best > 0.8 * 0.6 AND fall >= 0.3 * CASE WHEN best >= 1.5 * 0.8 THEN 0.5 ELSE 0.7 END THEN 'TRAILING_STOP' WHEN ret >= 0.8 THEN 'TAKE_PROFIT' WHEN age >= 80 THEN 'MAX_HOLD' END AS reason FROM d
    ), z AS (SELECT symbol, ek AS entry_k, side, p0, min(k) AS exit_k, arg_min(reason, k) AS exit_reason, arg_min(price, k) AS p1, arg_min(best, k) AS best, arg_min(worst, k) AS worst, arg_min(high, k) AS high, arg_min(low, k) AS low FROM x WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4
    ), y AS (SELECT *, CASE WHEN side = 'BUY' THEN p1 - p0 ELSE p0 - p1 END AS gross FROM z)
    SELECT symbol, entry_k, exit_k, side, {r("p0", "entry_price")}, {r("p1", "exit_price")}, {r("gross", "gross_pnl")}, {r("gross", "net_pnl")}, 0.0::DOUBLE AS fees, exit_reason, exit_k - entry_k AS hold_rows, {r("best", "best_pct")}, {r("worst", "worst_pct")}, {r("-worst", "mae_pct")}, {r("best", "mfe_pct")},
    {r("CASE WHEN side = 'BUY' THEN low ELSE high END", "mae_price")}, {r("CASE WHEN side = 'BUY' THEN high ELSE low END", "mfe_price")}, {r("CASE WHEN best > 0 THEN gross / p0 / best ELSE 0 END", "edge_captured")} FROM y"""
)
def exit_journal(spark, sf_dir):
    """Journal rows of the positions that ``exit_automaton`` follows."""
    regime = F.floor(F.col("price") / 20) % 3
    marks = rolling(ticks(spark, sf_dir), 1, lambda d, keys: d.withColumn("was", F.lag(regime).over(W.ordered(keys)))).drop("n")
    marks = marks.withColumn("side", F.when(regime > F.col("was"), "BUY").when(regime < F.col("was"), "SELL")).drop("was")
    out = X.exit_journal(marks.withColumns({"stop": F.lit(0.5), "take_profit": F.lit(0.8), "trail": F.lit(0.3)}))
    return rounded(out, "entry_price", "exit_price", "gross_pnl", "net_pnl", "best_pct", "worst_pct", "mae_pct", "mfe_pct", "mae_price", "mfe_price", "edge_captured")


@query(
    f"""WITH RECURSIVE {RET[5:]}, a AS (SELECT symbol AS channel, epoch_us(ts) / 1e6::DOUBLE AS instant, seq, CASE WHEN ret > 0 THEN 'UP' ELSE 'DOWN' END AS kind, row_number() OVER (PARTITION BY symbol ORDER BY epoch_us(ts), seq) AS n FROM rets WHERE abs(ret) > 0.5
    ), s AS (
      SELECT channel, seq, kind, n, true AS fired, [instant] AS passed, CASE WHEN kind = 'UP' THEN instant END AS up, CASE WHEN kind = 'DOWN' THEN instant END AS down FROM a WHERE n = 1
      UNION ALL
      SELECT channel, seq, kind, n, ok, CASE WHEN ok THEN list_append(passed, instant) ELSE passed END, CASE WHEN ok AND kind = 'UP' THEN instant ELSE up END, CASE WHEN ok AND kind = 'DOWN' THEN instant ELSE down END FROM (
        SELECT a.channel, a.seq, a.kind, a.n, a.instant, list_filter(s.passed, lambda x: x > a.instant - 36000) AS passed, s.up, s.down,
          coalesce(a.instant - CASE WHEN a.kind = 'UP' THEN s.up ELSE s.down END >= 3600, true) AND len(list_filter(s.passed, lambda x: x > a.instant - 36000)) < 8 AS ok FROM s JOIN a ON a.channel = s.channel AND a.n = s.n + 1) q)
    SELECT channel, kind, count(*) AS raised, count(*) FILTER (fired) AS fired, CAST(sum(seq) FILTER (fired) AS BIGINT) AS fired_seqs FROM s GROUP BY 1, 2"""
)
def capped_alerts(spark, sf_dir):
    """Alerts of large moves, an hour's pause by kind and eight in ten hours, as these ticks are minutes apart."""
    d = rolling(ticks(spark, sf_dir), 1, lambda d, keys: W.log_returns(d, keys)).where(F.abs("ret") > 0.5)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    out = PF.capped(d.select(F.col("symbol").alias("channel"), at.alias("at"), "seq", F.when(F.col("ret") > 0, "UP").otherwise("DOWN").alias("kind")), 3600.0, 8, 36_000.0)
    hit = F.when(F.col("fired"), 1)
    return out.groupBy("channel", "kind").agg(F.count("*").alias("raised"), F.count(hit).alias("fired"), F.sum(F.when(F.col("fired"), F.col("seq"))).alias("fired_seqs"))


Z = normal.sql_quantile("u")


@query(
    f"""{WIN}, d AS (SELECT symbol, seq, w, len(w) AS n, unnest(range(8)) AS draw FROM v WHERE len(w) >= 10), k AS (SELECT *, {P.SQL_DRAW.format(t="seq", i="draw", s=42)} % n AS place, ({P.SQL_DRAW.format(t="seq", i="draw", s=43)} + 0.5::DOUBLE) / 2147483648::DOUBLE AS u, list_stddev_pop(w) AS s FROM d)
    SELECT symbol, seq, draw, {r(f"w[place + 1] + CASE WHEN s > 0 THEN n ** -0.2::DOUBLE * s ELSE 1e-8 END * {Z}", "sample")} FROM k"""
)
def kernel_samples(spark, sf_dir):
    """Eight seeded draws from the kernel density of each window."""
    return rounded(kernel_draws(windows(spark, sf_dir), "window", "seq", 8), "sample").select("symbol", "seq", "draw", "sample")
