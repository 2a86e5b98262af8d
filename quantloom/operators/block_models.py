"""Ridge regressions and hidden Markov regimes block by block: what a block learns from is a bounded sum or window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from .carried import carried_over, finished
from .tiles import numbered


def ridge_by_block(rows: DataFrame, cols: tuple[str, ...], target: str, by: tuple[str, ...] = ("symbol",), into: str = "prediction", block: int = 100, forgetting: float = 0.995, penalty: float = 0.01, least: int = 30, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``rows`` with ``into``, the ridge prediction of each row from the blocks of its series before its own, and ``{into}_r2``, how well their fit explains them.

    A block hands on sums of products of (1, features, target), each row weighed by ``forgetting`` for every row of its
    series after it within the block; what reached it from before is weighed by ``forgetting`` for each of its rows. So a
    block of any series is a task, and a row is predicted before anything is learned from it. Features are brought to mean 0 and deviation 1
    by the same sums, and ``penalty`` is that share of the weight. Null features count as 0, rows with a null target are
    not learned; predictions are 0 until ``least`` rows' weight has come together. With ``by`` holding a regime too,
    each regime of a symbol is a series of its own.
    """
    ship_package(rows.sparkSession)
    d = numbered(rows.withColumn("__series", F.concat_ws("\x1f", *(F.col(c).cast("string") for c in by))), "__series", order)
    d = materialize(d.withColumn("tile", F.floor((F.col("n") - 1) / block)), "ridge-rows")  # read twice
    size = len(cols) + 2

    def design(part: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(part)), part[list(cols)].fillna(0.0).to_numpy(float), part[target].to_numpy(float)])

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        z = design(part)
        known = ~np.isnan(z[:, -1])
        weight = forgetting ** np.arange(len(z) - 1, -1, -1.0)
        z, weight = z[known], weight[known]
        whole = (z * weight[:, None]).T @ z
        return pd.DataFrame({"__series": [part["__series"].iloc[0]], "tile": part["tile"].iloc[0], "end": [[float(len(part)), *whole.ravel()]]})

    ends = d.select("__series", "tile", "n", *cols, target).groupBy("__series", "tile").applyInPandas(summed, "__series string, tile long, end array<double>")

    def step(end: np.ndarray, carry: np.ndarray | None) -> np.ndarray:
        return end[1:] + (0.0 if carry is None else forgetting ** end[0] * carry)

    def fill(part: pd.DataFrame, carry: np.ndarray | None) -> dict[str, np.ndarray]:
        zero = np.zeros(len(part))
        if carry is None or carry[0] < least:
            return {into: zero, f"{into}_r2": zero}
        sums = carry.reshape(size, size)
        mean = sums[0] / sums[0, 0]
        cov = sums / sums[0, 0] - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
        used = np.flatnonzero(scale[1:-1] > 1e-12) + 1
        x = (design(part)[:, used] - mean[used]) / scale[used]
        corr = cov[np.ix_(used, used)] / np.outer(scale[used], scale[used])
        cross = cov[used, -1] / scale[used]
        beta = np.linalg.solve(corr + penalty * np.eye(len(used)), cross) if len(used) else np.zeros(0)
        explained = (2 * beta @ cross - beta @ corr @ beta) / cov[-1, -1] if cov[-1, -1] > 1e-300 else 0.0
        return {into: mean[-1] + x @ beta, f"{into}_r2": np.full(len(part), np.clip(explained, 0.0, 1.0))}

    return finished(d, carried_over(ends, step, "__series"), (into, f"{into}_r2"), fill, "__series").drop("__series", "n", "tile")


def emissions(x: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """Densities of each row in each state, up to a factor of the row, none of them 0."""
    logs = -0.5 * (((x[:, None, :] - means) ** 2) / spreads + np.log(spreads)).sum(axis=2)
    return np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -600.0))


def fit_regimes(x: np.ndarray, states: int, rounds: int, stay: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transitions, means, variances) by expectation maximisation from equal shares of the rows by their first feature; states ascend in its mean."""
    count, width = x.shape
    shares = np.array_split(np.argsort(x[:, 0], kind="stable"), states)
    means = np.array([x[s].mean(axis=0) for s in shares])
    spreads = np.array([x[s].var(axis=0) + 1e-2 for s in shares])
    move = np.full((states, states), (1 - stay) / (states - 1))
    np.fill_diagonal(move, stay)
    for _ in range(rounds):
        e = emissions(x, means, spreads)
        ahead, scale = np.zeros((count, states)), np.zeros(count)
        p = np.full(states, 1 / states)
        for t in range(count):
            p = (p @ move if t else p) * e[t]
            scale[t] = p.sum()
            p = ahead[t] = p / scale[t]
        back = np.ones((count, states))
        for t in range(count - 2, -1, -1):
            back[t] = move @ (e[t + 1] * back[t + 1]) / scale[t + 1]
        post = ahead * back
        post /= post.sum(axis=1, keepdims=True)
        pairs = move * (ahead[:-1].T @ (e[1:] * back[1:] / scale[1:, None]))
        move = (pairs + 1e-3) / (pairs + 1e-3).sum(axis=1, keepdims=True)
        weight = post.sum(axis=0)[:, None] + 1e-6
        means = post.T @ x / weight
        spreads = np.maximum(post.T @ (x * x) / weight - means**2, 1e-2)
    order = np.argsort(means[:, 0], kind="stable")
    return move[np.ix_(order, order)], means[order], spreads[order]


def regimes_by_block(rows: DataFrame, cols: tuple[str, ...], states: int = 4, block: int = 100, keep: int = 1000, warm: int = 50, rounds: int = 8, sure: float = 0.4, key: str = "symbol", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``rows`` with ``regime_id``, ``confidence`` and ``entropy`` of a Gaussian hidden Markov model of the features.

    A model is fitted for each block on the newest ``keep`` rows before it, standardised by themselves, from ``warm`` rows
    on; each fit is a bounded group. The probabilities of states are then filtered forward over all rows, exactly: every
    row multiplies them by a matrix, the matrices of a block multiply to one, and what reaches a block is carried from
    block to block. States ascend in the mean of the first feature. ``regime_id`` is the likeliest state, or -1 where
    its probability is below ``sure`` or no model is fitted yet (confidence and entropy are 0 there). Null features count as 0.
    """
    ship_package(rows.sparkSession)
    d = materialize(numbered(rows, key, order).withColumn("tile", F.floor((F.col("n") - 1) / block)), "regime-rows")  # read three times
    kind = rows.schema[key].dataType.simpleString()
    width = len(cols)
    ahead = F.sequence(F.col("tile") + 1, F.floor((F.col("n") - 1 + keep) / block))
    last = d.groupBy(key).agg(F.max("tile").alias("__last"))
    learned = d.select(key, "n", *cols, F.explode(ahead).alias("block")).join(last, key).where(F.col("block") <= F.col("__last"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("n")[list(cols)].fillna(0.0).to_numpy(float)[-keep:]
        model = None
        if len(x) >= warm:
            mean, scale = x.mean(axis=0), x.std(axis=0)
            scale = np.where(scale > 1e-12, scale, 1.0)
            move, means, spreads = fit_regimes((x - mean) / scale, states, rounds)
            model = np.concatenate([mean, scale, move.ravel(), means.ravel(), spreads.ravel()]).tolist()
        return pd.DataFrame({key: [part[key].iloc[0]], "tile": part["block"].iloc[0], "model": [model]})

    fits = materialize(learned.groupBy(key, "block").applyInPandas(fit, f"{key} {kind}, tile long, model array<double>"), "regime-fits")

    def steps(part: pd.DataFrame) -> np.ndarray | None:
        """The matrix of each row: the row vector of probabilities times it, up to a factor, is the next one."""
        model = part["__model"].iloc[0]
        if model is None:
            return None
        model = np.asarray(model, float)
        mean, scale, rest = model[:width], model[width : 2 * width], model[2 * width :]
        move, means, spreads = rest[: states**2].reshape(states, states), rest[states**2 : states**2 + states * width].reshape(states, width), rest[states**2 + states * width :].reshape(states, width)
        x = (part[list(cols)].fillna(0.0).to_numpy(float) - mean) / scale
        return move[None, :, :] * emissions(x, means, spreads)[:, None, :]

    d = d.join(fits.withColumnRenamed("model", "__model"), [key, "tile"], "left")

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        whole, matrices = np.eye(states), steps(part)
        for m in matrices if matrices is not None else ():
            whole = whole @ m
            whole /= whole.sum()
        return pd.DataFrame({key: [part[key].iloc[0]], "tile": part["tile"].iloc[0], "end": [whole.ravel().tolist() if matrices is not None else []]})

    ends = d.select(key, "tile", "n", *cols, "__model").groupBy(key, "tile").applyInPandas(composed, f"{key} {kind}, tile long, end array<double>")
    even = np.full(states, 1 / states)

    def step(end: np.ndarray, carry: np.ndarray | None) -> np.ndarray:
        p = even if carry is None else carry
        if len(end):
            p = p @ end.reshape(states, states)
            p = p / p.sum()
        return p

    def fill(part: pd.DataFrame, carry: np.ndarray | None) -> dict[str, np.ndarray]:
        matrices = steps(part)
        if matrices is None:
            zero = np.zeros(len(part))
            return {"regime_id": zero - 1, "confidence": zero, "entropy": zero}
        p, out = even if carry is None else carry, np.zeros((len(part), states))
        for i, m in enumerate(matrices):
            p = p @ m
            p = out[i] = p / p.sum()
        best = out.max(axis=1)
        return {"regime_id": np.where(best >= sure, out.argmax(axis=1), -1.0), "confidence": best, "entropy": -(out * np.log(np.maximum(out, 1e-300))).sum(axis=1)}

    filled = finished(d, carried_over(ends, step, key), ("regime_id", "confidence", "entropy"), fill, key)
    return filled.withColumn("regime_id", F.col("regime_id").cast("long")).drop("n", "tile", "__model")
