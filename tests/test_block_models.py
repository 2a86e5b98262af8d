"""Volatility, ridge and regimes by block against plain loops over whole series."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import scans as S
from quantloom.operators.block_models import emissions, fit_regimes, regimes_by_block, ridge_by_block


def frame(parts):
    out = []
    for symbol, columns in parts.items():
        n = len(next(iter(columns.values())))
        out.append(pd.DataFrame({"symbol": symbol, "seq": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 37, unit="min"), **columns}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("tile_refits", [1, 3, 10])
def test_volatility_by_tiles_equals_one_loop(spark, tile_refits):
    r = np.random.default_rng(1)
    data = {"a": r.normal(0, 1e-3, 730), "b": r.normal(0, 2e-3, 60), "c": r.normal(0, 1e-3, 100)}
    got = S.garch_sigma(spark.createDataFrame(frame({k: {"ret": v} for k, v in data.items()})), refit=50, least=100, remembered=160, tile_refits=tile_refits).toPandas()
    for symbol, x in data.items():
        ours = got[got["symbol"] == symbol].sort_values("seq")["sigma"].to_numpy()
        assert len(ours) == len(x)
        fitted, h = None, 0.0
        for i in range(len(x)):
            seen = i + 1
            if seen >= 100 and (seen - 100) % 50 == 0:
                past = x[max(0, seen - 160) : seen]
                fitted = S.fit_garch(past)
                h = max((past**2).mean(), 1e-18)
                for v in past:
                    h = fitted[0] + fitted[1] * v * v + fitted[2] * h
            elif fitted:
                h = fitted[0] + fitted[1] * x[i] ** 2 + fitted[2] * h
            assert ours[i] == pytest.approx(np.sqrt(h) if fitted else np.std(x[:seen], ddof=1) if seen > 1 else 0.0, rel=1e-9, abs=1e-15)


def plain_ridge(x, y, block, forgetting, penalty, least):
    """Weights of all rows before a block, by the number of rows between them and it."""
    out = np.zeros(len(y))
    x = np.nan_to_num(x)
    for low in range(block, len(y), block):
        known = ~np.isnan(y[:low])
        w = forgetting ** np.arange(low - 1, -1, -1.0)[known]
        if w.sum() < least:
            continue
        a, b = x[:low][known], y[:low][known]
        m, my = (w[:, None] * a).sum(0) / w.sum(), (w * b).sum() / w.sum()
        s = np.sqrt((w[:, None] * (a - m) ** 2).sum(0) / w.sum())
        z = (a - m) / s
        beta = np.linalg.solve((z * w[:, None]).T @ z / w.sum() + penalty * np.eye(z.shape[1]), (z * w[:, None]).T @ (b - my) / w.sum())
        out[low : low + block] = my + (x[low : low + block] - m) / s @ beta
    return out


def test_ridge_by_block_equals_weighted_least_squares(spark):
    r = np.random.default_rng(2)
    parts = {}
    for symbol, n in (("a", 430), ("b", 90), ("c", 20)):
        x = r.normal(size=(n, 3)) + 5
        y = x @ [1.0, -2.0, 0.5] + 0.1 * r.normal(size=n)
        parts[symbol] = {"f0": np.where(r.random(n) < 0.05, np.nan, x[:, 0]), "f1": x[:, 1], "f2": x[:, 2], "y": np.where(r.random(n) < 0.1, np.nan, y), "regime": r.integers(0, 2, n)}
    rows = frame(parts)
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    for by in (("symbol",), ("symbol", "regime")):
        got = ridge_by_block(d, ("f0", "f1", "f2"), "y", by, block=40, least=30).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
        assert len(got) == len(rows)
        for _, part in got.groupby(list(by)):
            expected = plain_ridge(part[["f0", "f1", "f2"]].to_numpy(float), part["y"].to_numpy(float), 40, 0.995, 0.01, 30)
            np.testing.assert_allclose(part["prediction"].to_numpy(float), expected, rtol=1e-6, atol=1e-8)
            assert part["prediction_r2"].between(0, 1).all()
    a = got[(got["symbol"] == "a") & (got["seq"] > 300)]
    assert (a["prediction_r2"] > 0.5).all()


def test_regime_fit_finds_separate_states():
    r = np.random.default_rng(3)
    state = np.repeat([0, 1, 0, 1, 0], 80)
    x = np.column_stack([np.where(state, 2.0, -2.0), np.zeros(400)]) + 0.3 * r.normal(size=(400, 2))
    move, means, spreads = fit_regimes(x, 2, 10)
    assert means[0, 0] == pytest.approx(-2, abs=0.2) and means[1, 0] == pytest.approx(2, abs=0.2) and move.diagonal().min() > 0.95


def test_regimes_are_filtered_over_blocks_as_in_one_loop(spark):
    r = np.random.default_rng(4)
    cols, parts = ("u", "v"), {}
    for symbol, n in (("a", 330), ("b", 45), ("c", 120)):
        state = np.repeat(r.integers(0, 3, n // 15 + 1), 15)[:n]
        parts[symbol] = {"u": state * 3.0 + r.normal(size=n) * 0.5, "v": r.normal(size=n)}
    rows = frame(parts)
    got = regimes_by_block(spark.createDataFrame(rows), cols, states=3, block=40, keep=100, warm=30, rounds=5).toPandas().sort_values(["symbol", "seq"])
    for symbol, part in rows.groupby("symbol"):
        ours = got[got["symbol"] == symbol]
        x, p = part[list(cols)].to_numpy(float), np.full(3, 1 / 3)
        for low in range(0, len(x), 40):
            past = x[max(0, low - 100) : low]
            for i in range(low, min(low + 40, len(x))):
                if len(past) < 30:
                    expected = (-1, 0.0, 0.0)
                else:
                    if i == low:
                        mean, scale = past.mean(0), past.std(0)
                        move, means, spreads = fit_regimes((past - mean) / scale, 3, 5)
                    p = (p @ move) * emissions((x[i : i + 1] - mean) / scale, means, spreads)[0]
                    p = p / p.sum()
                    expected = (p.argmax() if p.max() >= 0.4 else -1, p.max(), -(p * np.log(np.maximum(p, 1e-300))).sum())
                row = ours.iloc[i]
                assert row["regime_id"] == expected[0] and row["confidence"] == pytest.approx(expected[1], abs=1e-9) and row["entropy"] == pytest.approx(expected[2], abs=1e-9)
    assert set(got[got["symbol"] == "a"]["regime_id"]) >= {0, 1, 2}
