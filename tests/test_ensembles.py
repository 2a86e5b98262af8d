"""Boosted trees by block and rollbacks: acceptance, planted breaks, brute-force twins."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators.boosting import boost, boosted_predictions, fitted_blocks, grow, predict, rollbacks
from quantloom.operators.tiles import numbered


def test_a_tree_finds_the_best_split():
    x = np.repeat(np.arange(8), 30)[:, None]
    y = np.where(x[:, 0] <= 2, -1.0, 1.0)
    column, cut, value = grow(x, y, 1, 10)
    assert (column[0], cut[0]) == (0, 2) and value.tolist() == [-1.0, 1.0]
    column, _, value = grow(x[:15], y[:15], 1, 10)  # too few rows for two leaves
    assert column[0] == -1 and value[0] == -1.0


def test_boosting_fits_what_a_mean_cannot():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 4))
    y = np.where(x[:, 1] > 0, x[:, 2], -x[:, 2]) + 0.1 * r.normal(size=1500)
    fit = boost(x[:1000], y[:1000], 100, 3, 0.1, 0.8, 10, 1)
    error = ((predict(x[1000:], *fit, 3) - y[1000:]) ** 2).mean()
    assert error < 0.5 * y[1000:].var()
    assert all((a == b).all() for a, b in zip(fit[1:], boost(x[:1000], y[:1000], 100, 3, 0.1, 0.8, 10, 1)[1:]))


@pytest.fixture(scope="module")
def rows(spark):
    """Symbol a can be learned up to row 600 and not after; symbol b is noise; c is short. Some features and targets are missing."""
    r = np.random.default_rng(3)
    parts = []
    for symbol, n in (("a", 1000), ("b", 500), ("c", 30)):
        x = r.normal(size=(n, 2))
        y = x[:, 0] * 2 + 0.2 * r.normal(size=n)
        if symbol == "a":
            y[600:] = r.normal(size=400) * 2
        elif symbol == "b":
            y = r.normal(size=n)
        parts.append(pd.DataFrame({"symbol": symbol, "seq": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"), "f0": x[:, 0], "f1": np.where(r.random(n) < 0.02, np.nan, x[:, 1]), "y": np.where(r.random(n) < 0.02, np.nan, y)}))
    frame = pd.concat(parts)
    from pyspark.sql import functions as F

    return frame, spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def test_blocks_are_fitted_on_the_rows_before_them(rows):
    frame, d = rows
    fits = {(f.symbol, f.block): f for f in fitted_blocks(numbered(d), ("f0", "f1"), "y", block=100, keep=300, least_rows=80, rounds=40).collect()}
    assert {b for s, b in fits if s == "a"} == set(range(1, 11)) and ("a", 0) not in fits
    a = frame[frame["symbol"] == "a"].reset_index(drop=True)
    for block in (1, 3, 5, 9):
        part = a.iloc[max(0, 100 * block - 300) : 100 * block].dropna(subset=["y"])
        x, y = part[["f0", "f1"]].fillna(0.0).to_numpy(), part["y"].to_numpy()
        split = int(len(y) * 0.8)
        fit = boost(x[:split], y[:split], 40, 3, 0.05, 0.8, 10, 42)
        error = ((predict(x[split:], *fit, 3) - y[split:]) ** 2).mean()
        f = fits["a", block]
        assert f.rows == len(y) and f.val_mse == pytest.approx(error) and f.val_var == pytest.approx(y[split:].var()) and f.accepted == (error < y[split:].var())
    # what can be learned is, and noise hardly
    assert all(fits["a", b].accepted and fits["a", b].val_mse < 0.2 * fits["a", b].val_var for b in range(1, 7))
    assert all(fits["a", b].val_mse > 0.8 * fits["a", b].val_var for b in range(9, 11))
    assert not fits["c", 1].accepted and fits["c", 1].val_mse is None


def test_predictions_come_from_the_newest_accepted_fit(rows):
    frame, d = rows
    out = boosted_predictions(d, ("f0", "f1"), "y", block=100, keep=300, least_rows=80, rounds=40).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    assert len(out) == len(frame) and set(d.columns) < set(out.columns)
    fits = {(f.symbol, f.block): f for f in fitted_blocks(numbered(d), ("f0", "f1"), "y", block=100, keep=300, least_rows=80, rounds=40).collect()}
    for symbol, part in out.groupby("symbol"):
        for block in range(-(-len(part) // 100)):
            own = part.iloc[100 * block : 100 * block + 100]
            accepted = [b for b in range(1, block + 1) if (symbol, b) in fits and fits[symbol, b].accepted]
            if not accepted:
                assert (own["gbt"] == 0).all() and own["gbt_block"].isna().all()
                continue
            f = fits[symbol, accepted[-1]]
            expected = predict(own[["f0", "f1"]].fillna(0.0).to_numpy(float), f.base, np.array(f.columns), np.array(f.cuts), np.array(f.values), 3)
            np.testing.assert_allclose(own["gbt"].to_numpy(float), expected)
            assert (own["gbt_block"] == accepted[-1]).all() and (own["gbt_accepted"] == (accepted[-1] == block)).all()
    a = out[(out["symbol"] == "a") & out["seq"].between(100, 599)].dropna(subset=["y"])
    assert np.corrcoef(a["gbt"].astype(float), a["y"])[0, 1] > 0.8


def test_the_blend_of_all_members_equals_a_plain_loop(spark, sf_dir):
    from quantloom.plans.registry import QUERIES

    out = QUERIES["ensemble_blocks"](spark, sf_dir).toPandas().sort_values(["symbol", "seq"])
    members = ["ridge", "by_regime", "momentum", "gbt"]
    assert len(out) > 500 and (out["ridge"] != 0).any() and (out["by_regime"] != 0).any()
    for _, part in out.groupby("symbol"):
        x, y = part[members].to_numpy(float), part["target"].to_numpy(float)
        w, errors = np.full(4, 0.25), []
        for i in range(len(part)):
            recent = np.array(errors[-100:])
            if i >= 50:
                known = recent[~np.isnan(recent).any(axis=1)]
                aim = 1 / np.maximum(known.mean(axis=0), 1e-10)
                w = 0.98 * w + 0.02 * aim / aim.sum()
            blend = (w * x[i]).sum() / w.sum() if i >= 50 else x[i].mean()
            row = part.iloc[i]
            np.testing.assert_allclose(row[[f"w_{m}" for m in members]].to_numpy(float), w, atol=2e-6)
            assert row["blend"] == pytest.approx(blend, abs=1e-7) and row["disagreement"] == pytest.approx(x[i].std(), abs=1e-7)
            errors.append(np.abs(y[i] - x[i]))


def test_a_planted_break_makes_the_version_go_back(spark):
    from math import erfc, sqrt

    r = np.random.default_rng(11)
    errors = {"good": np.abs(r.normal(size=400)), "breaks": np.abs(r.normal(size=400)), "short": np.abs(r.normal(size=70))}
    errors["breaks"][200:250] *= 4
    errors["breaks"][250:300] *= 16
    errors["breaks"][300:350] *= 64
    errors["breaks"][350:] *= 64
    errors["flat"] = np.full(150, 0.5)
    d = spark.createDataFrame([(m, i + 1, float(e)) for m, v in errors.items() for i, e in enumerate(v)], "model string, k long, error double")
    got = {(x.model, x.block): x for x in rollbacks(d, ("model",)).collect()}
    assert {k for k in got if k[0] == "short"} == {("short", 0)}
    for model, v in errors.items():
        version, skip = None, False
        for b in range(len(v) // 50):
            recent, g = v[50 * b : 50 * b + 50], got[model, b]
            if b:
                before = v[50 * b - 50 : 50 * b]
                ranks = pd.Series(np.concatenate([recent, before])).rank().to_numpy()
                u = ranks[:50].sum() - 1275
                ties = pd.Series(np.concatenate([recent, before])).value_counts().to_numpy(float)
                spread = sqrt(2500 / 12 * (101 - (ties**3 - ties).sum() / 9900))
                p = 0.5 * erfc((u - 1250 - 0.5) / spread / sqrt(2)) if spread else 1.0
                ratio = recent.mean() / before.mean()
                assert g.p == pytest.approx(p, abs=1e-6) and g.ratio == pytest.approx(ratio)
                degraded = ratio > 1.3 or p < 0.05
            else:
                degraded = False
            back = degraded and not skip
            skip = back
            version = version if back else b
            assert (g.degraded, g.rolled_back, g.version) == (degraded, back, version), (model, b)
    assert [got["breaks", b].rolled_back for b in (4, 5, 6)] == [True, False, True] and [got["breaks", b].version for b in (3, 4, 5, 6)] == [3, 3, 5, 5]
