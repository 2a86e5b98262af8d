"""Queries of densities on evaluation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as N
from ..operators import windows as W
from ..operators.tiles import rolling
from ..sources.views import ticks
from .common import query, r, rounded
from .tick_queries import RET, O, last

WIN = f"""{RET}, e AS (SELECT symbol, seq, ts, list(ret) FILTER (ret IS NOT NULL) OVER {last(150)} AS w, row_number() OVER ({O}) AS n FROM rets), v AS (SELECT symbol, seq, ts, w FROM e WHERE n > 150 AND n % 10 = 0)"""


def windows(spark, sf_dir):
    """Evaluation rows with the last 150 returns."""
    out = rolling(ticks(spark, sf_dir), 151, lambda d, keys: N.window_arrays(W.log_returns(d, keys), keys=keys))
    return W.evaluated(out).select("symbol", "seq", "ts", "k", "window")


POINTS = 1000


def mixtures(spark, sf_dir):
    """Evaluation rows with a mixture of each window; densities lie on a grid of four deviations on both sides of its mean."""
    return N.mixtures(windows(spark, sf_dir))


@query()
def gmm_density(spark, sf_dir):
    """Mixture of each window: parts, BIC, mass on the grid, entropy, mean log density and tail ratio; compared with numpy in the tests."""
    cols = ("mass", "entropy", "log_density", "tail_ratio")
    out = N.measures(mixtures(spark, sf_dir), POINTS).select("symbol", "seq", F.size("weights").alias("parts"), "bic", *cols)
    return rounded(out, "bic", *cols, digits=4)


@query()
def kl_shift(spark, sf_dir):
    """Divergence of each window's density from the one before, both on one grid that holds five deviations of every part."""
    parts = ("weights", "means", "vars")
    d = N.with_earlier(mixtures(spark, sf_dir).select("symbol", "seq", "k", *parts), parts)
    kl = N.mixture_divergence(tuple(map(F.col, parts)), tuple(F.col(f"was_1_{c}") for c in parts))
    return rounded(d.select("symbol", "seq", F.coalesce(kl, F.lit(0.0)).alias("kl")), "kl", digits=4)


@query()
def density_surface(spark, sf_dir):
    """How each window's density moves and what shape it has."""
    cols = ("velocity", "bifurcation", "peak", "slope", "curvature", "change", "spread_90")
    out = N.moves(mixtures(spark, sf_dir), POINTS)
    return rounded(out.select("symbol", "seq", *cols, "collapsed"), *cols, digits=4)


@query(
    f"""{WIN}, s AS (SELECT symbol, seq, w, len(w)::DOUBLE AS n, list_stddev_samp(w) * len(w) ** -0.2::DOUBLE AS h FROM v), g AS (SELECT symbol, seq, unnest([-2.0::DOUBLE, -1.0, 0.0, 1.0, 2.0]) AS x, w, n, h FROM s)
    SELECT symbol, seq, x, {r("list_sum(list_transform(w, lambda y: exp(-(x - y) * (x - y) / (2 * h * h)))) / (n * h * sqrt(2 * pi()))", "density")} FROM g"""
)
def kernel_density(spark, sf_dir):
    """Kernel density of each window at five points."""
    v = windows(spark, sf_dir)
    points = F.array(*(F.lit(float(x)) for x in (-2, -1, 0, 1, 2)))
    out = v.withColumn("d", N.kernel_density(points, F.col("window"))).select("symbol", "seq", F.explode(F.arrays_zip(points.alias("x"), F.col("d").alias("density"))).alias("p"))
    return rounded(out.select("symbol", "seq", "p.x", "p.density"), "density")


@query(
    f"""{WIN}, s AS (SELECT symbol, seq, list_sort(w) AS w, len(w) AS n FROM v), u AS (SELECT symbol, seq, n, unnest(range(1, n + 1)) AS i, w FROM s
    ), d AS (SELECT symbol, seq, n, list_sort(list_filter([abs(w[i] - w[i - 3]), abs(w[i] - w[i - 2]), abs(w[i] - w[i - 1]), abs(w[i] - w[i + 1]), abs(w[i] - w[i + 2]), abs(w[i] - w[i + 3])], lambda x: x IS NOT NULL))[3] AS g FROM (SELECT symbol, seq, n, i, list_concat([NULL, NULL, NULL], list_concat(w, [NULL, NULL, NULL])) AS w0, w FROM u) q
    )
    SELECT symbol, seq, {r("ln(any_value(n)) - 1 / (2.0::DOUBLE * any_value(n)) - 1 / (12.0::DOUBLE * any_value(n) * any_value(n)) - (-0.5772156649015329::DOUBLE + 1.5) + avg(ln(2 * greatest(g, 1e-15)))", "entropy")} FROM d GROUP BY 1, 2"""
)
def sample_entropy(spark, sf_dir):
    """Nearest-neighbour entropy of each window."""
    return rounded(windows(spark, sf_dir).select("symbol", "seq", N.nearest_neighbour_entropy(F.col("window")).alias("entropy")), "entropy")
