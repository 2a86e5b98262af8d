"""Stationarity tests against plain regressions, ranks against enumeration, quantiles, exponential means and filters over tiles."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import performance as P
from quantloom.operators import quantiles as QT
from quantloom.operators import relational as REL
from quantloom.operators import scans as S
from quantloom.operators.carried import exponential_mean
from quantloom.operators.density import kernel_draws
from quantloom.operators.ranks import exact_probability, mean_ranks, rank_correlation, rank_sum, rank_sum_counts
from quantloom.operators.tiles import tiled
from quantloom.operators.unit_roots import stationarity_tests, unit_root_probability


def plain_unit_root(x):
    """Least squares on the levels themselves, lags by AIC over the common places, then over all places of the lags chosen."""
    n, d = len(x), np.diff(x)
    top = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))

    def design(p, first):
        t = np.arange(first, len(d))
        return np.column_stack([x[t], np.ones(len(t)), *(d[t - i] for i in range(1, p + 1))]), d[t]

    def rest(p, first):
        a, b = design(p, first)
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        e = b - a @ beta
        return a, beta, float(e @ e), len(b)

    scores = []
    for p in range(top + 1):
        a, _, ssr, m = rest(p, top)
        scores.append(m * (math.log(2 * math.pi) + math.log(ssr / m) + 1) + 2 * (p + 2))
    p = int(np.argmin(scores))
    a, beta, ssr, m = rest(p, p)
    se = math.sqrt(ssr / (m - p - 2) * np.linalg.inv(a.T @ a)[0, 0])
    return beta[0] / se, p


def plain_level(x):
    e, n = x - x.mean(), len(x)
    lags = int(n ** (2 / 9))
    s0 = e @ e / n
    s1 = 0.0
    for i in range(1, lags + 1):
        g = 2 * (e[i:] @ e[:-i]) / n
        s0, s1 = s0 + g, s1 + i * g
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    v = e @ e + 2 * sum((1 - i / (width + 1)) * (e[i:] @ e[:-i]) for i in range(1, width + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / (v / n), width


@pytest.mark.parametrize("tile_rows", [60, 10_000])
def test_stationarity_tests_equal_plain_regressions(spark, tile_rows):
    r = np.random.default_rng(1)
    walk, noise = np.cumsum(r.normal(size=700)) + 50, r.normal(3, 2, 500)
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.6 * ar[i - 1] + r.normal()
    series = {"walk": walk, "noise": noise, "ar": ar, "flat": np.full(80, 2.5), "short": r.normal(size=19), "trend": np.arange(300) * 0.1 + r.normal(size=300), "tiny": r.normal(size=21)}
    frame = pd.concat([pd.DataFrame({"name": k, "seq": np.arange(len(v)), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(v)), unit="h"), "x": v}) for k, v in series.items()])
    d = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("ar", 9999, pd.Timestamp("2024-03-01").to_pydatetime(), float("nan"))], "name string, seq long, ts timestamp, x double"))
    got = {r.name: r for r in stationarity_tests(d, ("name",), tile_rows=tile_rows).collect()}
    assert set(got) == set(series) - {"short"}
    for name in ("walk", "noise", "ar", "trend", "tiny"):
        statistic, lags = plain_unit_root(series[name])
        level, width = plain_level(series[name])
        g = got[name]
        assert (g.n, g.adf_lags, g.kpss_lags) == (len(series[name]), lags, width), name
        assert g.adf == pytest.approx(statistic, rel=1e-6) and g.kpss == pytest.approx(level, rel=1e-8)
        assert g.adf_p == pytest.approx(unit_root_probability(statistic), abs=1e-6) and 0.01 <= g.kpss_p <= 0.1
    assert got["noise"].verdict == got["ar"].verdict == "STATIONARY" and got["walk"].verdict == "NON-STATIONARY"
    assert (got["flat"].adf, got["flat"].adf_p, got["flat"].kpss) == (0.0, 1.0, 0.0)
    assert stationarity_tests(d.limit(0), ("name",)).count() == 0


def test_unit_root_probabilities_at_the_published_critical_values():
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert unit_root_probability(statistic) == pytest.approx(p, abs=2e-3)
    assert unit_root_probability(3.0) == 1.0 and unit_root_probability(-20.0) == 0.0


@pytest.mark.parametrize("n1, n2", [(1, 1), (2, 5), (4, 4), (3, 7)])
def test_rank_sum_counts_by_enumeration(n1, n2):
    ways = np.zeros(n1 * n2 + 1, int)
    for first in itertools.combinations(range(n1 + n2), n1):
        ways[sum(first) - n1 * (n1 - 1) // 2] += 1
    assert rank_sum_counts(n1, n2).tolist() == ways.tolist()
    for u in range(n1 * n2 + 1):
        assert exact_probability(u, n1, n2, False) == pytest.approx(ways[u:].sum() / ways.sum())
        assert exact_probability(u, n1, n2) == pytest.approx(min(1, 2 * ways[max(u, n1 * n2 - u) :].sum() / ways.sum()))


@pytest.mark.parametrize("ranges", [1, 50])
def test_ranks_do_not_depend_on_ranges(spark, ranges):
    r = np.random.default_rng(7)
    frame = pd.DataFrame({"g": r.choice(["hot"] * 8 + ["a", "b"], 3000), "x": r.integers(0, 40, 3000).astype(float), "y": r.normal(size=3000), "one": r.random(3000) < 0.3})
    d = spark.createDataFrame(frame)
    got = mean_ranks(d, "x", ("g",), "rank", ranges).toPandas().sort_values(["g", "y"])["rank"].to_numpy()
    frame["rank"] = frame.groupby("g")["x"].rank()
    np.testing.assert_allclose(got, frame.sort_values(["g", "y"])["rank"].to_numpy())
    rho = {x.g: x.rho for x in rank_correlation(d, "x", "y", ("g",), ranges).collect()}
    tests = {x.g: x for x in rank_sum(d, "x", "one", ("g",), ranges=ranges).collect()}
    for g, part in frame.groupby("g"):
        assert rho[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()))
        first = part.loc[part["one"], "rank"]
        assert tests[g].u == pytest.approx(first.sum() - len(first) * (len(first) + 1) / 2) and tests[g].method == "normal" and 0 <= tests[g].p <= 1


def test_rank_sum_counts_out_small_groups(spark):
    rows = [("s", float(v), v in (9, 10, 11)) for v in range(1, 12)] + [("empty", 1.0, True)] + [("equal", 2.0, i < 2) for i in range(5)] + [("nulls", None, True), ("nulls", 1.0, None)]
    got = {r.g: r for r in rank_sum(spark.createDataFrame(rows, "g string, v double, one boolean"), "v", "one", ("g",)).collect()}
    assert (got["s"].u, got["s"].method) == (24.0, "exact") and got["s"].p == pytest.approx(2 / math.comb(11, 3))
    assert got["empty"].p is None and got["equal"].p == 1.0 and "nulls" not in got


@pytest.mark.parametrize("held", [50, 1_000_000])
def test_quantiles_are_exact_whatever_is_held(spark, held):
    r = np.random.default_rng(3)
    frame = pd.DataFrame({"g": r.choice(["a", "b", "c"], 6000, p=[0.8, 0.19, 0.01]), "v": np.where(r.random(6000) < 0.3, 1.0, r.standard_cauchy(6000) * 1e6)})
    frame.loc[frame["g"] == "c", "v"] = 7.0
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = QT.exact_quantiles(spark.createDataFrame(frame), "v", shares, ("g",), held).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["q0", "q5", "q50", "q95", "q100"]].to_numpy(float), np.quantile(part["v"], shares), rtol=1e-12)
    whole = QT.exact_quantiles(spark.createDataFrame(frame), "v", (0.31,), (), held).first()
    assert whole.q31 == pytest.approx(np.quantile(frame["v"], 0.31), rel=1e-12)


def test_execution_report_beyond_what_is_held(spark, sf_small):
    from quantloom.sources.views import fills

    f = fills(spark, sf_small)
    key = lambda r: (r["dim"], r["value"])
    few, many = ({key(r): r for r in REL.execution_report(f, held=n).collect()} for n in (10**6, 500))
    assert few.keys() == many.keys()
    for k, r in few.items():
        assert many[k]["median_bps"] == pytest.approx(r["median_bps"]) and many[k]["p95_bps"] == pytest.approx(r["p95_bps"]) and many[k]["n"] == r["n"]


@pytest.fixture(scope="module")
def walk(spark):
    r = np.random.default_rng(8)
    frame = pd.DataFrame({"symbol": ["a"] * 700 + ["b"] * 300, "seq": np.arange(1000), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(1000) * 777, unit="s"), "price": 50 + np.cumsum(r.normal(size=1000))})
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("tile_rows", [35, 10_000])
def test_exponential_mean_and_level_over_tiles(walk, tile_rows):
    frame, d = walk
    for start in (None, 0.25):
        got = exponential_mean(tiled(d, tile_rows), "price", 0.9, "ema", start).toPandas().sort_values("seq")
        for _, part in got.groupby("symbol"):
            mean = start
            for x, ours in zip(part["price"], part["ema"]):
                mean = x if mean is None else 0.9 * mean + 0.1 * x
                assert ours == pytest.approx(mean, rel=1e-10)
    got = S.kalman_level(d, tile_rows=tile_rows).toPandas().sort_values("seq")
    for symbol, part in frame.groupby("symbol"):
        level, error = None, 1.0
        for x, ours in zip(part["price"], got[got["symbol"] == symbol]["level"]):
            if level is None:
                level = x
            else:
                wide = error + 1e-4
                gain = wide / (wide + 1e-2)
                level, error = level + gain * (x - level), (1 - gain) * wide
            assert ours == pytest.approx(level, rel=1e-10)


def test_a_hot_symbol_s_level_is_many_groups(walk):
    assert tiled(walk[1], 35).where("symbol = 'a'").select("tile").distinct().count() == 20


@pytest.mark.parametrize("block_symbols, chunk_rows", [(256, 200_000), (2, 40)])
def test_correlations_in_blocks(spark, block_symbols, chunk_rows):
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 7)) @ r.normal(size=(7, 7)) + 1e4
    frame = pd.DataFrame([(f"s{j}", i, x[i, j]) for i in range(120) for j in range(7) if r.random() < 0.8], columns=["symbol", "slot", "ret"])
    wide = frame.pivot(index="slot", columns="symbol", values="ret")
    got = REL.correlations(spark.createDataFrame(frame), block_symbols, chunk_rows).collect()
    assert len(got) == 21
    for row in got:
        both = wide[[row.a, row.b]].dropna()
        assert row.a < row.b and row.n == len(both) and row.rho == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)


def test_split_ranks_of_matrix_and_join_agree(spark):
    r = np.random.default_rng(6)
    rows = [(t, b, float(r.normal(0.1 * (t == 3)))) for t in range(9) for b in range(6) for _ in range(8)] + [(8, b, 0.0) for b in range(6)]
    d = spark.createDataFrame(rows, "trial long, block int, ret double")
    one, two = (P.combinatorial_overfit(d, 6, most).first() for most in (100, 1))
    assert one.splits == two.splits == math.comb(6, 3) and one.pbo == pytest.approx(two.pbo) and one.mean_logit == pytest.approx(two.mean_logit)


def test_kernel_draws_follow_their_window(spark):
    r = np.random.default_rng(5)
    windows = {1: r.normal(4, 2, 60).tolist(), 2: [3.0] * 30, 3: [1.0] * 9}
    d = spark.createDataFrame(list(windows.items()), "k long, w array<double>")
    got, again = (kernel_draws(d, "w", "k", 4000, seed=9).toPandas().sort_values(["k", "draw"]) for _ in range(2))
    assert (got["sample"].to_numpy() == again["sample"].to_numpy()).all() and set(got["k"]) == {1, 2}
    a, b = (got[got["k"] == k]["sample"] for k in (1, 2))
    w = np.array(windows[1])
    assert abs(a.mean() - w.mean()) < 0.15 and a.std() == pytest.approx(w.std() * math.sqrt(1 + 60**-0.4), rel=0.06)
    assert abs(b - 3.0).max() < 1e-6 and b.std() > 0
    assert (kernel_draws(d, "w", "k", 100, seed=10).toPandas()["sample"].iloc[0]) != got["sample"].iloc[0]
