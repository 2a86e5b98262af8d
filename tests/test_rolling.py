"""Rolling features and carried values on awkward ticks: bad prices, constant stretches, zero volumes, missing quotes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import portfolio as PF
from quantloom.operators import relational as REL
from quantloom.operators import windows as W
from quantloom.operators.carried import last_known
from quantloom.operators.tiles import rolling, tiled


@pytest.fixture(scope="module")
def frame():
    """Two symbols of 1500 ticks: a price a hundredfold too high, a constant stretch, volumes mostly zero, quotes that are missing or crossed."""
    r, parts = np.random.default_rng(4), []
    for symbol in ("a", "b"):
        price = 100 * np.exp(np.cumsum(r.normal(0, 1e-4, 1500)))
        price[400] *= 100
        price[900:1200] = price[900]
        volume = np.where(r.random(1500) < 0.8, 0.0, r.integers(1, 50, 1500))
        volume[700:1100] = 0.0
        bid = np.where(r.random(1500) < 0.3, np.nan, price - 0.01)
        ask = np.where(r.random(1500) < 0.5, price - 0.05, price + 0.02)
        ask[300:650] = bid[300:650] - 0.01
        parts.append(pd.DataFrame({"symbol": symbol, "seq": np.arange(1500), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(1500) * 97, unit="s"), "price": price, "volume": volume, "bid": bid, "ask": ask}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def rows(spark, frame):
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return spark.createDataFrame(frame).select("symbol", "seq", "ts", "price", "volume", nan("bid"), nan("ask")).cache()


def sorted_pandas(df):
    return df.toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)


@pytest.mark.parametrize("tile_rows", [7, 100, 10_000])
def test_moments_forget_a_bad_tick(frame, rows, tile_rows):
    got = sorted_pandas(rolling(rows, 151, lambda d, k: W.zscore(W.moments(W.log_returns(d, k), keys=k), n=90, keys=k), tile_rows=tile_rows))
    for symbol, part in frame.groupby("symbol"):
        ret = np.log(part["price"].to_numpy())
        ret = np.concatenate([[np.nan], np.diff(ret)])
        ours = got[got["symbol"] == symbol]
        for i in (5, 11, 150, 399, 401, 549, 551, 552, 700, 899, 1049, 1060, 1199, 1250, 1499):
            x = ret[max(0, i - 149) : i + 1]
            x = x[~np.isnan(x)]
            c = x - x.mean()
            m2 = 0.0 if x.min() == x.max() else (c**2).mean()
            few = len(x) < 10
            expected = (0, 0, 0, 0) if few else (x.mean(), np.sqrt(m2 * len(x) / (len(x) - 1)), (c**3).mean() / m2**1.5 if m2 else 0, (c**4).mean() / m2**2 - 3 if m2 else 0)
            np.testing.assert_allclose(ours.iloc[i][["mu", "sigma", "skew", "kurt"]].to_numpy(float), expected, rtol=1e-7, atol=1e-12)
            p = part["price"].to_numpy()[max(0, i - 89) : i + 1]
            z = 0.0 if p.min() == p.max() else (p[-1] - p.mean()) / p.std(ddof=1)
            assert abs(ours.iloc[i]["z"] - z) < 1e-6 * max(1, abs(z))


@pytest.mark.parametrize("tile_rows", [7, 100, 10_000])
def test_sums_forget_a_bad_tick(rows, tile_rows):
    big = rows.withColumn("volume", F.when(F.col("seq") == 300, 1e18).otherwise(F.col("volume")))
    sums = lambda d, k: W.sliding_sums(d, {"s": F.col("volume")}, 40, k, newest=3)
    got = sorted_pandas(rolling(big, 43, sums, tile_rows=tile_rows))
    for _, part in got.groupby("symbol"):
        v = part["volume"].to_numpy()
        for i in (2, 3, 20, 302, 303, 342, 343, 400, 1499):
            assert part["s"].iloc[i] == pytest.approx(v[max(0, i - 42) : max(0, i - 2)].sum(), rel=1e-14), i


@pytest.mark.parametrize("tile_rows", [7, 150, 10_000])
def test_means_of_valid_rows_reach_over_tiles(frame, rows, tile_rows):
    tiles = rolling(rows, 1, lambda d, k: W.log_returns(d, k), tile_rows=tile_rows, keep_tile=True)
    got = sorted_pandas(W.amihud(W.spread_stats(tiles, n=20), n=50))
    for symbol, part in frame.groupby("symbol"):
        ours = got[got["symbol"] == symbol]
        ret = np.concatenate([[np.nan], np.diff(np.log(part["price"].to_numpy()))])
        ratios, spreads = [], []
        for i, (v, b, a) in enumerate(zip(part["volume"], part["bid"], part["ask"])):
            if v > 1e-8 and not np.isnan(ret[i]):
                ratios.append(abs(ret[i]) / v)
            if a > b:
                spreads.append(a - b)
            assert ours["amihud"].iloc[i] == pytest.approx(np.mean(ratios[-50:]) if ratios else 0.0, rel=1e-9, abs=1e-15)
            assert ours["mean_spread"].iloc[i] == pytest.approx(np.mean(spreads[-20:]) if spreads else 0.0, rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("tile_rows", [7, 10_000])
def test_last_known_values_reach_over_tiles(frame, rows, tile_rows):
    got = sorted_pandas(last_known(tiled(rows, tile_rows), {"b": F.col("bid"), "v": F.when(F.col("volume") > 0, F.col("volume"))}))
    marks = sorted_pandas(PF.mark_prices(rows, tile_rows))
    for symbol, part in frame.groupby("symbol"):
        ours, mark = got[got["symbol"] == symbol], marks[marks["symbol"] == symbol]
        bid, ask = part["bid"].ffill().to_numpy(), part["ask"].ffill().to_numpy()
        np.testing.assert_array_equal(ours["b"].to_numpy(float), bid)
        np.testing.assert_array_equal(ours["v"].to_numpy(float), part["volume"].where(part["volume"] > 0).ffill().to_numpy())
        expected = np.where(ask >= bid, (ask + bid) / 2, part["price"].to_numpy())
        np.testing.assert_allclose(mark["mark"].to_numpy(), expected)
        np.testing.assert_allclose(mark["mark_ret"].to_numpy(float)[1:], np.diff(np.log(expected)), atol=1e-12)


def test_quotes_and_books_as_of_do_not_depend_on_tiles(spark, sf_small):
    from quantloom.functions import decisions as D
    from quantloom.sources.views import quotes, ticks

    q = quotes(spark, sf_small).withColumn("symbol", F.lit(1))
    t = q.select("symbol", (F.col("seq") + 100_000).alias("seq"), "ts")
    one, two = ({tuple(r) for r in REL.as_of_quotes(t, q, tile_rows=n).select("seq", "bid", "ask").collect()} for n in (11, 10_000))
    assert one == two
    snap = F.col("seq") % 9 == 0
    book = ticks(spark, sf_small).withColumns({"bids": F.when(snap, D.levels(F.col("price"), F.lit(0.01), F.col("bid_size"), -1)), "asks": F.when(snap, D.levels(F.col("price"), F.lit(0.01), F.col("ask_size"), 1))})
    one, two = ({tuple(r) for r in PF.with_book(book, n).select("symbol", "seq", "spread", "imbalance", "pressure", "liquid").collect()} for n in (5, 10_000))
    assert one == two


def test_written_tables_can_be_cleaned_up(spark):
    from pathlib import Path

    from quantloom import cluster

    cluster.cleanup(spark)
    d = cluster.materialize(spark.range(5), "once")
    path = Path(d.inputFiles()[0].removeprefix("file://")).parent
    assert d.count() == 5 and path.exists()
    assert cluster.cleanup(spark) == 1 and not path.exists() and cluster.cleanup(spark) == 0


def test_carried_values_of_a_hot_symbol_are_many_tasks(spark):
    hot = spark.range(4000).select(F.lit("x").alias("symbol"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.when(F.col("id") % 700 == 0, F.col("id") * 1.0).alias("bid"))
    out = last_known(tiled(hot, 100), {"b": F.col("bid")}).withColumn("task", F.spark_partition_id())
    assert out.where(F.col("b") != F.floor(F.col("seq") / 700) * 700).count() == 0
    assert out.select("tile").distinct().count() == 40


@pytest.mark.parametrize("tile_windows", [1, 3, 1000])
def test_time_windows_reach_over_tiles_of_time(frame, rows, tile_windows):
    returns = rolling(rows, 1, lambda d, k: W.log_returns(d, k))
    got = sorted_pandas(W.sixty_seconds(returns, seconds=3000, least=10, tile_windows=tile_windows))
    assert len(got) == len(frame)
    for symbol, part in frame.groupby("symbol"):
        ours = got[got["symbol"] == symbol]
        at = part["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        ret = np.concatenate([[np.nan], np.diff(np.log(part["price"].to_numpy()))])
        for i in (0, 5, 10, 11, 40, 400, 420, 1499):
            x = ret[(at >= at[i] - 3_000_000_000) & (at <= at[i])]
            x = x[~np.isnan(x)]
            row = ours.iloc[i]
            if len(x) < 10:
                assert np.isnan(row["vol_60"])
            else:
                assert row["vol_60"] == pytest.approx(x.std(), rel=1e-9) and row["drift_60"] == pytest.approx(x.mean(), rel=1e-7, abs=1e-12) and row["intensity_60"] == pytest.approx(len(x) / 3000)


@pytest.mark.parametrize("tile_rows", [5, 10_000])
def test_entropy_streaks_reach_over_tiles(spark, tile_rows):
    from quantloom.operators.entries import edge_decay

    r = np.random.default_rng(9)
    n = 300
    d = pd.DataFrame({"symbol": "a", "seq": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"), "divergence": r.random(n), "velocity": r.normal(size=n), "acceleration": r.normal(size=n), "entropy_velocity": r.normal(size=n) + 0.3, "side": r.choice(["BUY", "SELL"], n)})
    got = edge_decay(spark.createDataFrame(d), 0.2, 3, tile_rows).toPandas().sort_values("seq")["decay"].tolist()
    streak = 0
    for i, x in enumerate(d.itertuples()):
        sign = 1 if x.side == "BUY" else -1
        if x.divergence < 0.2:
            expected = "COLLAPSED"
        elif sign * x.velocity < 0 and sign * x.acceleration < 0:
            expected = "REACCELERATED"
        else:
            streak = streak + 1 if x.entropy_velocity > 0 else 0
            expected = "ENTROPY_RISES" if streak >= 3 else None
        assert (None if pd.isna(got[i]) else got[i]) == expected, i
