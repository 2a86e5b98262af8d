"""Library tests: oracles on the smallest tables, numpy twins of recurrences, sources, sinks, streams, invariants."""

import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom.functions import decisions as D
from quantloom.functions import normal
from quantloom.operators import density as N
from quantloom.operators import entries as E
from quantloom.operators import portfolio as PF
from quantloom.operators import quality as Q
from quantloom.operators import relational as REL
from quantloom.operators import reports as RP
from quantloom.operators import scans as S
from quantloom.operators import trades as X
from quantloom.operators import windows as W
from quantloom.operators.tiles import numbered, rolling
from quantloom.plans import registry
from quantloom.sources import readers, writers
from quantloom.sources.views import ticks
from quantloom.streaming import ticks as stream

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_duckdb(spark, duck, sf_small, name):
    ours, theirs = registry.QUERIES[name](spark, sf_small).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1.1e-6)) or str(u) == str(v), (name, x, y)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["symbol", "seq", "mu", "sigma", "skew", "kurt"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_corpus_subpackage():
    root = Path(registry.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


@pytest.mark.parametrize("tile_rows", [7, 60, 1000])
def test_tiles_change_nothing(spark, sf_small, tile_rows):
    t = ticks(spark, sf_small)
    whole = W.moments(W.log_returns(t)).select("symbol", "seq", "mu", "sigma").collect()
    tiled = rolling(t, 151, lambda d, keys: W.moments(W.log_returns(d, keys), keys=keys), tile_rows=tile_rows).select("symbol", "seq", "mu", "sigma").collect()
    near = lambda rs: {(r.symbol, r.seq): (round(r.mu, 9), round(r.sigma, 9)) for r in rs}
    assert near(whole) == near(tiled) and len(whole) == len(tiled)


@pytest.mark.parametrize("tile_rows", [9, 50])
def test_tiles_change_no_kernel(spark, sf_small, tile_rows):
    t = ticks(spark, sf_small)
    for make in (W.hill_slope, W.rolling_var, W.autocorrelations, W.persistence, W.left_tail_alpha):
        whole, tiled = (rolling(t, 302, lambda d, keys: make(W.log_returns(d, keys), keys=keys), tile_rows=n).toPandas().sort_values(["symbol", "seq"]) for n in (10_000, tile_rows))
        new = [c for c in whole.columns if c not in t.columns]
        assert np.allclose(whole[new].astype(float), tiled[new].astype(float), equal_nan=True), make.__name__
    marks = t.withColumns({"side": F.when(F.col("seq") % 3 == 0, "BUY").when(F.col("seq") % 3 == 1, "SELL"), "stop": F.lit(0.5), "take_profit": F.lit(0.8), "trail": F.lit(0.3), "regime_id": F.floor(F.col("price") / 20) % 3})
    assert sorted(map(tuple, X.exits(marks, 20).collect())) == sorted(map(tuple, X.exits(marks, 20, tile_rows=tile_rows).collect()))
    curves = [{tuple(r)[:4]: round(r.curve, 9) for r in REL.forward_curves(marks, 20, n).collect()} for n in (10_000, tile_rows)]
    assert curves[0] == curves[1] and curves[0]


def test_a_hot_symbol_is_many_tasks(spark):
    d = frame(spark, np.cumsum(np.random.default_rng(2).normal(0, 1, 3000)) + 500).repartition(8)
    out = rolling(d, 151, lambda rows, keys: W.moments(W.log_returns(rows, keys), keys=keys), tile_rows=200)
    # so few rows would be broadcast or put together again
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        assert len(out.groupBy(F.spark_partition_id()).agg(F.sum("mu")).collect()) > 4
    finally:
        for key in small:
            spark.conf.unset(key)


def test_numbering(spark, sf_small):
    got = {(r.symbol, r.seq): r.n for r in numbered(ticks(spark, sf_small)).collect()}
    expected = {}
    for r in sorted(ticks(spark, sf_small).collect(), key=lambda r: (r.symbol, r.ts, r.seq)):
        expected[r.symbol, r.seq] = 1 + sum(1 for k in expected if k[0] == r.symbol)
    assert got == expected


def frame(spark, prices, symbol="A"):
    base = pd.Timestamp("2024-01-01")
    data = [(symbol, i, (base + pd.Timedelta(seconds=i)).to_pydatetime(), float(p), 10.0, float(p) - 0.01, float(p) + 0.01, 1.0, 1.0, "x") for i, p in enumerate(prices)]
    return spark.createDataFrame(data, readers.TICK)


def test_first_return_and_monotone_prices(spark):
    d = W.log_returns(frame(spark, range(100, 160))).orderBy("seq").collect()
    assert d[0].ret is None and d[1].ret == pytest.approx(math.log(101 / 100))
    v = S.toxicity(frame(spark, range(100, 700)), size=100.0).collect()
    assert v and all(r.vpin > 0.5 for r in v)


def test_kalman_derivatives_twin(spark):
    r = np.random.default_rng(1)
    z = np.cumsum(r.normal(0, 1, 200)) + 500
    got = [(x.velocity, x.acceleration) for x in S.kalman_derivatives(frame(spark, z)).orderBy("seq").collect()]
    f, h = np.array([[1, 1, 0.5], [0, 1, 1], [0, 0, 1]]), np.array([[1.0, 0, 0]])
    x, p, q = np.array([z[0], 0, 0]), np.eye(3), np.diag([1e-6, 1e-5, 1e-4])
    expected = [(0.0, 0.0)]
    for m in z[1:]:
        x, p = f @ x, f @ p @ f.T + q
        k = p @ h.T / (h @ p @ h.T + 1e-4)
        x, p = x + k[:, 0] * (m - x[0]), (np.eye(3) - k @ h) @ p
        expected.append((x[1], x[2]))
    assert np.allclose(got, expected)


def test_hmm_separates_two_regimes():
    r = np.random.default_rng(0)
    model = S.GaussianHmm(["x", "y"], states=2)
    block = np.arange(900) // 20 % 2  # both regimes within the warm-up
    x = r.normal(0, 0.1, (900, 2)) + 5 * block[:, None]
    out = model(pd.DataFrame({"symbol": "A", "seq": range(900), "x": x[:, 0], "y": x[:, 1]}))
    share = (out.regime_id[100:].to_numpy() == block[100:]).mean()
    assert max(share, 1 - share) > 0.95 and ((0 <= out.confidence) & (out.confidence <= 1 + 1e-9)).all()


def test_rate_limit_is_greedy(spark):
    out = S.rate_limited(frame(spark, range(1, 41)), per_second=2, per_minute=6, second=5.0, minute=20.0).orderBy("seq").collect()
    passed, expected = [], []
    for t in range(40):
        ok = sum(t - 5 < p for p in passed) < 2 and sum(t - 20 < p for p in passed) < 6
        expected.append(ok)
        passed += [t] * ok
    assert [r.admitted for r in out] == expected


def test_quality_flags_jump_and_cross(spark):
    r = random.Random(2)
    d = frame(spark, [150 + r.uniform(-0.01, 0.01) for _ in range(50)] + [200])
    d = d.withColumn("ask", F.when(F.col("seq") == 20, F.col("bid") - 1).otherwise(F.col("ask")))
    found = {(x.seq, i.issue, i.severity) for x in Q.quality_issues(d).collect() for i in x.issues}
    assert found == {(50, "PRICE_JUMP", "CRITICAL"), (20, "CROSSED_MARKET", "CRITICAL")}
    assert Q.quality_gate(Q.quality_issues(d)).count() == 49


def test_normal_columns(spark):
    d = spark.createDataFrame([(p,) for p in (0.001, 0.01, 0.3, 0.5, 0.77, 0.999)], "p double")
    for r in d.select("p", normal.cumulative(normal.quantile(F.col("p"))).alias("q")).collect():
        assert r.q == pytest.approx(r.p, abs=2e-7)


def test_mixture_and_entropy(spark):
    r = np.random.default_rng(3)
    weights, means, spread, _ = N.fit_mixture(np.concatenate([r.normal(-2, 0.3, 200), r.normal(2, 0.3, 200)]))
    assert len(weights) >= 2 and min(means) < -1.5 and max(means) > 1.5 and sum(weights) == pytest.approx(1)
    assert N.fit_mixture(np.zeros(5)) is None
    d = spark.createDataFrame([([float(x) for x in r.normal(0, 1, 2000)],)], "w array<double>")
    h = d.select(N.nearest_neighbour_entropy(F.col("w")).alias("h")).first().h
    assert h == pytest.approx(0.5 * math.log(2 * math.pi * math.e), abs=0.1)


def test_decision_rules(spark):
    one = spark.range(1)
    k = one.select(D.kelly(F.lit(0.6), F.lit(1.0)).alias("a"), D.kelly(F.lit(0.2), F.lit(1.0)).alias("b"), D.kelly(F.lit(float("nan")), F.lit(0.0)).alias("c")).first()
    assert (round(k.a, 9), k.b, k.c) == (0.2, 0.0, 0.0)
    size = lambda tail: one.select(D.position_size(F.lit(1e5), F.lit(100.0), F.lit(0.05), F.lit(0.6), F.lit(1.5), F.lit(1.0), F.lit(tail), F.lit(0.0), F.lit(0.0)).alias("s")).first().s
    assert size(4.0) < size(1.0)
    impact = lambda q: one.select(D.market_impact(F.lit(q), F.lit(10.0), F.lit(0.02), F.lit(1000.0)).alias("i")).first().i.bps
    assert impact(500.0) > impact(5.0) > 0 == impact(0.0)
    x = one.select(D.exit_parameters(F.lit(0.02), F.lit(0.0), F.lit(9.0), F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(0.3)).alias("x")).first().x
    assert x.take_profit >= x.stop * x.rr and 5 <= x.hold <= 160


def test_csv_source(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("timestamp,price,volume\n2024-01-01 00:00:02,101,5\n2024-01-01 00:00:01,100,nan\nbad,100,1\n2024-01-01 00:00:03,-1,1\n2024-01-01 00:00:04,x,1\n")
    got = readers.csv_ticks(spark, f"file://{path}", "A").orderBy("ts", "seq").collect()
    assert [(r.symbol, r.price, r.volume, r.exchange, r.bid) for r in got] == [("A", 100.0, 0.0, "generic", None), ("A", 101.0, 5.0, "generic", None)]


def test_store_and_replay(spark, tmp_path):
    t = readers.synthetic_ticks(spark, 2, 200)
    path = f"file://{tmp_path}/ticks"
    writers.store_ticks(t, path)
    back = readers.stored_ticks(spark, path, symbol="S1")
    assert back.count() == 200
    want = sorted((r.seq, r.price) for r in t.where("symbol = 'S1'").collect())
    assert sorted((r.seq, r.price) for r in back.collect()) == want
    assert {tuple(r) for r in t.collect()} == {tuple(r) for r in readers.tick_source(spark, {"symbols": 2, "rows": 200}).collect()}


def test_ledger(spark, tmp_path):
    data = [("FILL", "A", "BUY", 12.0, 0.25), ("FILL", "A", "SELL", 2.0, 0.2), ("REJECT", "A", "BUY", 9.0, 9.0)]
    path = f"file://{tmp_path}/ledger"
    writers.append_ledger(spark.createDataFrame(data[:2], "event_type string, symbol string, side string, qty double, fees double"), path)
    writers.append_ledger(spark.createDataFrame(data[2:], "event_type string, symbol string, side string, qty double, fees double"), path)
    got = writers.replay_ledger(spark.read.csv(path, header=True)).first()
    assert (got.symbol, got.position, round(got.fees, 9), got.fills) == ("A", 10.0, 0.45, 2)


def test_book_export_keeps_the_last_side(spark):
    level = "array<struct<px: long, sz: long>>"
    ts = pd.Timestamp("2024-01-01").to_pydatetime()
    data = [("A", 1, ts, "A", 0, 0, 0, [(99_000_000_000, 3)], [(101_000_000_000, 4)]), ("A", 2, ts, "T", 0, 100_500_000_000, 7, [], [(102_000_000_000, 1), (0, 5)])]
    d = spark.createDataFrame(data, f"symbol string, seq long, ts timestamp_ntz, action string, depth int, price long, size long, bids {level}, asks {level}")
    got = readers.book_export(d).orderBy("seq").collect()
    assert [(r.price, r.volume, r.bid, r.ask) for r in got] == [(100.0, 0.0, 99.0, 101.0), (100.5, 7.0, 99.0, 102.0)]
    assert readers.book_export(d, trades_only=True).count() == 1


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    t = readers.synthetic_ticks(spark, 2, 400).withColumn("volume", F.col("volume") * 20)
    path = f"file://{tmp_path}/in"
    t.orderBy("ts").coalesce(1).write.parquet(path)
    buckets = {(r.symbol, r.bucket, round(r.imbalance, 9)) for r in run_stream(spark, stream.stream_volume_buckets(readers.stream_ticks(spark, path)), "buckets").collect()}
    assert buckets == {(r.symbol, r.bucket, round(r.imbalance, 9)) for r in S.toxicity(t).collect()} and buckets
    bars = run_stream(spark, stream.time_bars(readers.stream_ticks(spark, path)), "bars", "complete").collect()
    expected = stream.time_bars(t).collect()
    key = lambda r: (r.symbol, r.start, r.open, r.high, r.low, r.close, r.n)
    assert sorted(map(key, bars)) == sorted(map(key, expected)) and sum(r.n for r in bars) == 800
    assert run_stream(spark, stream.gap_alerts(readers.stream_ticks(spark, path)), "gaps", "complete").count() == stream.gap_alerts(t).count()


def test_book_moves_levels():
    from quantloom.operators.models import BookDynamics

    book = BookDynamics()
    for args in ((0, "BID", 0, 99.0, 5.0), (0, "BID", 0, 100.0, 1.0), (1, "BID", 1, 99.5, 4.0), (0, "ASK", 0, 101.0, 2.0)):
        book.step(*args)
    assert book.sides["BID"][:3] == [(100.0, 1.0), (99.5, 4.0), None] and book.totals == {"BID": 5.0, "ASK": 2.0}
    book.step(2, "BID", 0, 0.0, 0.0)
    assert book.sides["BID"][:2] == [(99.5, 4.0), None] and book.pulled["BID"] == pytest.approx(0.2 + 0.95**2 / 6) and book.pulled["ASK"] == 0
    for _ in range(25):
        book.step(1, "ASK", 0, 101.0, 2.0)
    assert book.flashed == 0
    book.step(1, "ASK", 0, 101.0, 50.0)
    assert book.flashed == 1.0


def test_transitions_start_at_one_half():
    from quantloom.operators.models import Transitions

    r = np.random.default_rng(4)
    regime = np.arange(400) // 25 % 2
    part = pd.DataFrame({"symbol": "A", "seq": range(400), "regime_id": regime, "mu": r.normal(0, 1, 400) + 4 * regime, "e": r.normal(0, 1, 400)})
    out = Transitions(("mu", "e"), (1.0, 1.0))(part)
    assert len(out) == 15 and out.probability[0] == 0.5 and out.probability.between(0, 1).all() and (out.from_regime != out.to_regime).all()


def test_ensemble_prefers_the_model_that_knows():
    from quantloom.operators.models import Ensemble

    r = np.random.default_rng(5)
    x = r.normal(0, 1, 1500)
    out = Ensemble(["x"], "y", "m")(pd.DataFrame({"symbol": "A", "seq": range(1500), "regime_id": 0, "x": x, "m": r.normal(0, 50, 1500), "y": 2 * x}))
    assert out.w_momentum.iloc[-1] < 0.2 and out[["w_ridge", "w_regime", "w_momentum"]].iloc[-1].sum() == pytest.approx(1)


def test_boosted_trees_beat_the_mean_or_say_nothing(spark):
    from quantloom.operators.models import boosted_trees

    r = np.random.default_rng(6)
    data = [(i, float(x), float(np.sign(x)), float(z)) for i, (x, z) in enumerate(zip(r.normal(0, 1, 300), r.normal(0, 1, 300)))]
    d = spark.createDataFrame(data, "i int, x double, y double, z double")
    assert boosted_trees(d, ["x"], "y", "i < 200", rounds=3).count() == 100


def test_feature_table_equals_single_queries(spark, sf_small):
    joint = registry.QUERIES["feature_table"](spark, sf_small).toPandas().set_index(["symbol", "seq"]).sort_index()
    for name, cols in (("rolling_moments", ["mu", "sigma", "skew", "kurt"]), ("momentum_50_200", ["mom_50", "mom_200"]), ("kyle_lambda", ["kyle"]), ("flow_toxicity", ["toxicity", "intensity"])):
        single = registry.QUERIES[name](spark, sf_small).toPandas().set_index(["symbol", "seq"]).sort_index()
        assert np.allclose(joint[cols].astype(float), single[cols].astype(float), atol=2e-6), name


def test_garch_fit_finds_its_parameters():
    r = np.random.default_rng(8)
    omega, alpha, beta, h, x = 0.1, 0.12, 0.8, 1.0, []
    for _ in range(4000):
        x.append(r.normal() * math.sqrt(h))
        h = omega + alpha * x[-1] ** 2 + beta * h
    w, a, b = S.fit_garch(np.array(x))
    assert abs(a - alpha) < 0.04 and abs(b - beta) < 0.08 and 0.03 < w < 0.3


def test_mixture_grids_and_divergence(spark):
    row = ([0.4, 0.6], [-1.0, 2.0], [0.5, 1.5])
    d = spark.createDataFrame([(*row, [1.0], [0.0], [1.0])], "w array<double>, m array<double>, v array<double>, w2 array<double>, m2 array<double>, v2 array<double>")
    got = d.select(N.mixture_density(F.lit(-8.0), F.lit(10.0), F.col("w"), F.col("m"), F.col("v"), 1000).alias("pdf"), N.mixture_divergence(tuple(map(F.col, ("w", "m", "v"))), tuple(map(F.col, ("w2", "m2", "v2")))).alias("kl"), N.density_at(F.lit(0.3), F.col("w"), F.col("m"), F.col("v")).alias("at")).first()
    x = np.linspace(-8, 10, 1000)
    p = sum(w / np.sqrt(2 * np.pi * v) * np.exp(-((x - m) ** 2) / 2 / v) for w, m, v in zip(*row))
    q = np.exp(-(x**2) / 2) / np.sqrt(2 * np.pi)
    assert np.allclose(got.pdf, p) and sum(p) * (x[1] - x[0]) == pytest.approx(1, abs=1e-6)
    assert got.kl == pytest.approx(float((p * np.log(p / q)).sum() * (x[1] - x[0])), rel=1e-3)
    assert got.at == pytest.approx(0.4 / math.sqrt(math.pi) * math.exp(-1.69) + 0.6 / math.sqrt(3 * math.pi) * math.exp(-(1.7**2) / 3))
    values = np.random.default_rng(1).normal(0, 1, (5, 150))
    many = N.fit_mixtures(values)
    assert all(np.allclose(np.hstack(N.fit_mixture(v)[:3]), np.hstack(m[:3])) for v, m in zip(values, many))


def test_t_probability(spark):
    x = np.linspace(3.5, 80, 400_001)
    tail = np.trapezoid(math.gamma(15.5) / math.sqrt(30 * math.pi) / math.gamma(15) * (1 + x * x / 30) ** -15.5, x)
    known = [(2.0, 10, 0.073388), (1.0, 1, 0.5), (3.5, 30, 2 * tail), (0.0, 5, 1.0), (-2.042272, 30, 0.05)]
    d = spark.createDataFrame([(t, v) for t, v, _ in known], "t double, v int")
    assert np.allclose([r.p for r in d.select("t", RP.t_probability(F.col("t"), F.col("v")).alias("p")).collect()], [p for *_, p in known], atol=2e-6)


def test_predictive_regimes_ban_noise(spark):
    r = np.random.default_rng(3)
    data = [("A", 0, i, float(x)) for i, x in enumerate(r.normal(0.5, 1, 200))] + [("A", 1, i, float(x)) for i, x in enumerate(r.permutation(np.linspace(-1, 1, 200)))] + [("A", 2, i, 1.0) for i in range(5)]
    got = {x.regime_id: (x.banned, x.reason) for x in RP.predictive_regimes(spark.createDataFrame(data, "symbol string, regime_id int, at int, ret double")).collect()}
    assert got == {0: (False, "PREDICTIVE"), 1: (True, "NOT_PREDICTIVE"), 2: (False, "TOO_FEW")}


def test_bootstrapped_transitions(spark):
    rows = [(0.6, 1.0, 0, True, 200), (0.4, 1.0, 0, True, 200), (-3.0, 1.0, 0, True, 200), (0.6, 1.0, -1, True, 200), (0.6, 1.0, 0, False, 200), (0.6, 0.0, 0, True, 200), (0.6, 1.0, 0, True, 100)]
    d = spark.createDataFrame(rows, "v double, s double, r int, flat boolean, n int")
    assert [x.b for x in d.select(E.bootstrapped(*map(F.col, "v s r flat n".split())).alias("b")).collect()] == [0.3, None, 1.0, None, None, None, None]


def test_halts_stay(spark):
    base = pd.Timestamp("2024-01-01")
    rows = [("A", (base + pd.Timedelta(seconds=i)).to_pydatetime(), i, 0.9 if i != 7 else 0.0, 0.0 if i != 5 else 0.5, 0.0, 0.0, 99) for i in range(12)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, confidence double, slippage double, fall double, cvar double, since_transition int")
    got = PF.halts(d).orderBy("seq").collect()
    assert [r.halted for r in got] == [False] * 5 + [True] * 7 and {r.reason for r in got} == {None, "SLIPPAGE"} and got[-1].since == 6


def test_search_points_stay_in_their_ranges(spark):
    space = [("a", 1.0, 5.0, False), ("b", 1e-6, 1e-3, True)]
    got = RP.search_points(spark, space, 300).collect()
    assert len(got) == 600 and all(lo <= r.value <= hi for r in got for n, lo, hi, _ in space if n == r.name)
    logs = [math.log10(r.value) for r in got if r.name == "b"]
    assert -4.8 < sum(logs) / len(logs) < -4.2


def test_scaled_exports_logs_and_states(spark, tmp_path):
    d = spark.createDataFrame([("A", 101_000_000_000.0, None, None), ("A", None, 99.0, 101.0)], "symbol string, price double, bid double, ask double")
    assert [r.price for r in readers.scaled_export(d).collect()] == [101.0, 100.0]
    (tmp_path / "log.csv").write_text("n,reason\n1,a\nx,b\n3,c\n")
    assert [(r.n, r.reason) for r in readers.log_rows(spark, f"file://{tmp_path}/log.csv", "n int, reason string").collect()] == [(1, "a"), (3, "c")]
    path, now = f"file://{tmp_path}/states", pd.Timestamp("2024-01-01 10:00").to_pydatetime()
    states = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, level double")
    writers.save_state(states, path, now - pd.Timedelta(seconds=400).to_pytimedelta())
    writers.save_state(states.where("symbol = 'B'").withColumn("level", F.lit(3.0)), path, now - pd.Timedelta(seconds=100).to_pytimedelta())
    assert [(r.symbol, r.level) for r in readers.restored_state(spark, path, now).collect()] == [("B", 3.0)]
    regimes = spark.createDataFrame([("A", now, None, 0.5, 1.0)], "symbol string, ts timestamp, regime_id long, confidence double, entropy double")
    writers.store_regimes(regimes, f"file://{tmp_path}/regimes")
    assert spark.read.parquet(f"file://{tmp_path}/regimes").first().regime_id == -1


def test_feature_vector_equals_single_queries(spark, sf_small):
    joint = registry.QUERIES["feature_vector"](spark, sf_small).toPandas().set_index(["symbol", "seq"]).sort_index()
    assert joint.shape[1] == 38
    for name, cols in (("rolling_moments", ["mu", "sigma", "skew", "kurt"]), ("momentum_50_200", ["mom_50", "mom_200"]), ("kyle_lambda", ["kyle"]), ("hill_tail", ["tail_slope"]), ("autocorr_lags", ["ac_1", "ac_5", "ac_10"]), ("vol_of_vol", ["vol_of_vol"])):
        single = registry.QUERIES[name](spark, sf_small).toPandas().set_index(["symbol", "seq"]).loc[joint.index]
        assert np.allclose(joint[cols].astype(float), single[cols].astype(float), atol=2e-6), name
