"""Recurrences over each symbol's ordered rows, as bounded-memory scans of sorted partitions.

Only recurrences that no window expresses are here. Rows are partitioned by symbol, sorted by Spark (which spills),
and read batch by batch; a kernel keeps the state of one symbol and never holds its rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism, ship_package
from .carried import tracked_level
from .tiles import spread, tiled


def scan(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, key: str = "symbol", order=("ts", "seq")) -> DataFrame:
    """Feed each key's rows in order, in slices, to a kernel made for it; a slice that comes back empty gives no rows."""
    ship_package(df.sparkSession)

    def run(batches):
        current, kernel = None, None
        for batch in batches:
            runs = (batch[key] != batch[key].shift()).cumsum()
            for _, part in batch.groupby(runs, sort=False):
                if kernel is None or part[key].iloc[0] != current:
                    current, kernel = part[key].iloc[0], make()
                out = kernel(part)
                if len(out):
                    yield out

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class VolumeBuckets:
    """Numbers ticks by volume buckets that close at ``size`` and start again from nothing: the overflow is dropped."""

    def __init__(self, size: float):
        self.size, self.bucket, self.volume, self.price = size, 0, 0.0, None

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        buckets, buys, closes = [], [], []
        for price, volume in zip(part["price"].tolist(), part["volume"].tolist()):
            buckets.append(self.bucket)
            buys.append(volume if self.price is not None and price >= self.price else 0.0)
            self.volume += volume
            self.price = price
            done = self.volume >= self.size
            closes.append(done)
            if done:
                self.bucket, self.volume, self.price = self.bucket + 1, 0.0, None
        return pd.DataFrame({"symbol": part["symbol"], "seq": part["seq"], "ts": part["ts"], "bucket": buckets, "volume": part["volume"], "buy": buys, "closes": closes})


def volume_buckets(ticks: DataFrame, size: float = 500.0) -> DataFrame:
    """(symbol, seq, ts, bucket, volume, buy, closes): a tick's bucket and its buying volume by the tick rule.

    The first tick of a bucket has no price before it and counts as selling.
    """
    schema = "symbol string, seq long, ts timestamp_ntz, bucket long, volume double, buy double, closes boolean"
    return scan(ticks.select("symbol", "seq", "ts", "price", "volume"), lambda: VolumeBuckets(size), schema)


def toxicity(ticks: DataFrame, size: float = 500.0, buckets: int = 50) -> DataFrame:
    """(symbol, bucket, closed, imbalance, vpin): the imbalance of each closed bucket and the mean of the last 50."""
    closed = volume_buckets(ticks, size).groupBy("symbol", "bucket").agg(F.max("ts").alias("closed"), F.sum("volume").alias("volume"), F.sum("buy").alias("buy"), F.max("closes").alias("done")).where("done")
    imbalance = F.abs(2 * F.col("buy") - F.col("volume")) / F.greatest("volume", F.lit(1e-10))
    closed = closed.select("symbol", "bucket", "closed", imbalance.alias("imbalance"))
    return closed.withColumn("vpin", F.avg("imbalance").over(Window.partitionBy("symbol").orderBy("bucket").rowsBetween(1 - buckets, 0)))


def kalman_level(ticks: DataFrame, process: float = 1e-4, measurement: float = 1e-2, tile_rows: int = 10_000) -> DataFrame:
    """(symbol, seq, level): the price followed with fixed process and measurement variances, tile by tile."""
    rows = tiled(ticks.select("symbol", "seq", "ts", "price"), tile_rows)
    return tracked_level(rows, "price", process, measurement, "level").select("symbol", "seq", "level")


class Kalman3D:
    """Position, velocity and acceleration of one measured column; non-finite measurements leave the state."""

    STEP = np.array([[1.0, 1.0, 0.5], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])

    def __init__(self, col: str, process: float, measurement: float):
        self.col, self.noise, self.r = col, np.diag([process, process * 10, process * 100]), measurement
        self.x, self.p, self.started = np.zeros(3), np.eye(3), False

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        velocity, acceleration = [], []
        for z in part[self.col].tolist():
            if np.isfinite(z) and not self.started:
                self.x[0], self.started = z, True
            elif np.isfinite(z):
                x, p = self.STEP @ self.x, self.STEP @ self.p @ self.STEP.T + self.noise
                gain = p[:, 0] / max(p[0, 0] + self.r, 1e-30)
                self.x, self.p = x + gain * (z - x[0]), p - np.outer(gain, p[0])
            velocity.append(self.x[1])
            acceleration.append(self.x[2])
        return pd.DataFrame({"symbol": part["symbol"], "seq": part["seq"], "velocity": velocity, "acceleration": acceleration})


def kalman_derivatives(rows: DataFrame, col: str = "price", process: float = 1e-6, measurement: float = 1e-4) -> DataFrame:
    schema = "symbol string, seq long, velocity double, acceleration double"
    return scan(rows.select("symbol", "seq", "ts", col), lambda: Kalman3D(col, process, measurement), schema)


class GaussianHmm:
    """Forward filter and incremental Baum-Welch of a Gaussian hidden Markov model.

    The first ``warmup`` observations place the states by k-means++ from a fixed seed; until then the posterior is
    uniform. The learning rate grows up to twice with surprising observations, and transition rows that come too near to
    certainty are drawn towards uniform.
    """

    def __init__(self, cols, states=4, warmup=50, rate=0.01, floor=1e-4, sticky=4.0, max_row_kl=None, blend=0.03, least=0.4):
        self.cols, self.k, self.warmup, self.base_rate, self.floor, self.blend, self.least = list(cols), states, warmup, rate, floor, blend, least
        self.max_row_kl = 0.8 * np.log(states) if max_row_kl is None else max_row_kl
        self.a = np.full((states, states), 1.0) + np.eye(states) * sticky
        self.a /= self.a.sum(axis=1, keepdims=True)
        self.held, self.alpha, self.surprise, self.ready = [], None, 0.0, False

    def _place(self):
        x, r = np.array(self.held), np.random.default_rng(42)
        means = [x[r.integers(len(x))]]
        while len(means) < self.k:
            d = np.min([((x - m) ** 2).sum(axis=1) for m in means], axis=0)
            means.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[r.integers(len(x))])
        self.means = np.array(means)
        self._separate(x, r)
        spread = np.diag(np.maximum(x.var(axis=0), self.floor))
        self.cov, self.ready, self.held = np.array([spread.copy() for _ in range(self.k)]), True, []

    def _separate(self, x, r):
        """Push a state that lies within half a deviation of one before it to one and a half times that distance, along a random direction."""
        deviation = x.std(axis=0)
        least = max(0.5 * float(np.linalg.norm(deviation)), 0.1)
        for later in range(1, self.k):
            for earlier in range(later):
                if np.linalg.norm(self.means[later] - self.means[earlier]) < least:
                    way = r.standard_normal(x.shape[1])
                    way /= max(float(np.linalg.norm(way)), 1e-12)
                    self.means[later] = self.means[earlier] + 1.5 * least * way

    def _emissions(self, x):
        d = x - self.means
        sign, logdet = np.linalg.slogdet(self.cov)
        solved = np.linalg.solve(self.cov, d[..., None])[..., 0]
        logs = -0.5 * ((d * solved).sum(axis=1) + logdet + len(x) * np.log(2 * np.pi))
        return np.exp(np.clip(logs, -700, 700))

    def step(self, x: np.ndarray) -> np.ndarray:
        """Posterior after one observation, which then updates the model."""
        uniform = np.full(self.k, 1 / self.k)
        if not np.isfinite(x).all():
            return uniform if self.alpha is None else self.alpha
        if not self.ready:
            self.held.append(x)
            if len(self.held) < self.warmup:
                return uniform
            self._place()
        b, was = self._emissions(x), self.alpha
        alpha = b * (self.a.T @ was if was is not None else uniform)
        self.alpha = alpha / alpha.sum() if alpha.sum() >= 1e-300 else uniform
        now = -np.log(max(float(b @ self.alpha), 1e-300))
        self.surprise = 0.95 * self.surprise + 0.05 * now
        rate = self.base_rate * float(np.clip(now / self.surprise, 1, 2)) if self.surprise > 1e-10 else self.base_rate
        for k in range(self.k):
            g = rate * self.alpha[k]
            delta = x - self.means[k]
            self.means[k] += g * delta
            self.cov[k] = (1 - g) * self.cov[k] + g * np.outer(delta, delta)
            diagonal = np.einsum("ii->i", self.cov[k])
            np.maximum(diagonal, self.floor, out=diagonal)
        if was is not None:
            xi = was[:, None] * self.a * b[None, :]
            if xi.sum() > 1e-300:
                self.a = (1 - rate) * self.a + rate * xi / xi.sum()
            self.a /= self.a.sum(axis=1, keepdims=True)
        safe = np.maximum(self.a, 1e-300)
        peaked = (safe * np.log(safe * self.k)).sum(axis=1) > self.max_row_kl
        self.a[peaked] = (1 - self.blend) * self.a[peaked] + self.blend / self.k
        self.a /= self.a.sum(axis=1, keepdims=True)
        return self.alpha

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        posts = np.array([self.step(x) for x in part[self.cols].to_numpy(np.float64)])
        best = posts.argmax(axis=1)
        top = posts.max(axis=1)
        entropy = -(posts * np.log(np.maximum(posts, 1e-300))).sum(axis=1)
        return pd.DataFrame({"symbol": part["symbol"], "seq": part["seq"], "regime_id": np.where(top >= self.least, best, -1), "confidence": top, "entropy": entropy})


def hmm_regimes(states: DataFrame, cols) -> DataFrame:
    """(symbol, seq, regime_id, confidence, entropy); -1 below a confidence of 0.4."""
    return scan(states.select("symbol", "seq", "ts", *cols), lambda: GaussianHmm(cols), "symbol string, seq long, regime_id long, confidence double, entropy double")


class OnlinePredictor:
    """Linear prediction by stochastic gradient with decay, forgetting and running normalisation.

    Each row is predicted, then learned from: its target moves the weights with the features as they were normalised
    for the prediction, which also feed the running means and variances.
    """

    def __init__(self, cols, target, rate=0.001, l2=1e-4, forgetting=0.995, least=50, remembered=500):
        self.cols, self.target, self.rate, self.l2, self.forgetting, self.least = list(cols), target, rate, l2, forgetting, least
        d = len(self.cols)
        self.w, self.b, self.mean, self.var, self.t_mean, self.t_var, self.n = np.zeros(d), 0.0, np.zeros(d), np.ones(d), 0.0, 1.0, 0
        self.errors = deque(maxlen=remembered)

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        predictions, confidences = [], []
        for row, y in zip(part[self.cols].to_numpy(np.float64), part[self.target].tolist()):
            x = (row - self.mean) / np.sqrt(self.var + 1e-8)
            guess = float(self.w @ x) + self.b
            spread = float(np.std(self.errors)) if len(self.errors) > 5 else 1.0
            predictions.append(guess)
            confidences.append(0.0 if self.n < self.least else 1 / (1 + spread / np.sqrt(max(self.t_var, 1e-10))))
            error = y - guess
            self.errors.append(error)
            step = self.rate / (1 + 0.001 * self.n)
            self.w = (self.w - step * (self.l2 * self.w - error * x)) * self.forgetting
            self.b += step * error
            if self.n == 0:
                self.mean, self.var, self.t_mean, self.t_var = x.copy(), np.ones(len(x)), y, 1.0
            else:
                d, t = x - self.mean, y - self.t_mean
                self.mean, self.var = self.mean + 0.01 * d, 0.99 * self.var + 0.01 * d * d
                self.t_mean, self.t_var = self.t_mean + 0.01 * t, 0.99 * self.t_var + 0.01 * t * t
            self.n += 1
        return pd.DataFrame({"symbol": part["symbol"], "seq": part["seq"], "actual": part[self.target], "prediction": predictions, "confidence": confidences})


def online_predictions(rows: DataFrame, cols, target: str) -> DataFrame:
    schema = "symbol string, seq long, actual double, prediction double, confidence double"
    return scan(rows.select("symbol", "seq", "ts", *cols, target), lambda: OnlinePredictor(cols, target), schema)


def fit_garch(x: np.ndarray, rounds: int = 6, side: int = 9) -> tuple[float, float, float]:
    """(omega, alpha, beta) of the greatest Gaussian likelihood of zero-mean returns."""
    return tuple(float(p[0]) for p in fit_garchs(np.asarray(x, float)[None, :], rounds, side))


def fit_garchs(x: np.ndarray, rounds: int = 6, side: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(omega, alpha, beta) for each row of ``x``, a series of returns of mean zero, by the greatest Gaussian likelihood.

    Ever finer grids around the best point of the last one, in the share of shocks and the persistence, all points of
    the grids of all rows at once; omega gives the sample's variance in the long run.
    """
    square = np.asarray(x, float) ** 2
    count, each = len(square), np.arange(len(square))
    level = np.maximum([float(s.mean()) for s in square], 1e-18)
    low, high = np.zeros((count, 2)), np.tile([0.5, 0.999], (count, 1))
    cost, best = np.full(count, np.inf), np.tile([0.05, 0.9], (count, 1))
    for _ in range(rounds):
        grids = [[g.ravel() for g in np.meshgrid(np.linspace(a[0], b[0], side), np.linspace(a[1], b[1], side))] for a, b in zip(low, high)]
        alpha, total = (np.array([g[k] for g in grids]) for k in (0, 1))
        alpha = np.minimum(alpha, total)
        omega, beta = level[:, None] * (1 - total), total - alpha
        h, found, part, shock = np.repeat(level[:, None], side * side, axis=1), np.zeros(alpha.shape), np.empty(alpha.shape), np.empty(alpha.shape)
        for v in np.ascontiguousarray(square.T)[:, :, None]:  # in arrays that are filled again
            np.log(h, out=part)
            part += np.divide(v, h, out=shock)
            found += part
            np.multiply(alpha, v, out=shock)
            shock += omega
            np.multiply(beta, h, out=h)
            np.add(shock, h, out=h)
            np.maximum(h, 1e-18, out=h)
        i = found.argmin(axis=1)
        better = found[each, i] < cost
        cost = np.where(better, found[each, i], cost)
        best = np.where(better[:, None], np.column_stack([alpha[each, i], total[each, i]]), best)
        step = (high - low) / (side - 1)
        low, high = np.maximum(best - step, 0.0), np.minimum(best + step, [0.5, 0.999])
    return level * (1 - best[:, 1]), best[:, 0], best[:, 1] - best[:, 0]


def garch_sigma(returns: DataFrame, refit: int = 200, least: int = 100, remembered: int = 1000, tile_refits: int = 10) -> DataFrame:
    """(symbol, seq, sigma): GARCH(1,1) deviation with parameters refitted by likelihood every ``refit`` returns; the sample deviation before ``least``.

    A refit takes the last ``remembered`` returns and runs the variance over them, so it owes nothing to the one before.
    Tiles of ``tile_refits`` refits bring that many returns from before them, and a symbol is as many tasks as it has tiles.
    A tile's refits of as many returns are made together.
    """
    ship_package(returns.sparkSession)

    def refits(x: np.ndarray, ends: list[int]) -> dict[int, tuple[float, float, float, float]]:
        """(omega, alpha, beta, variance after them) of the returns that end with each place of ``ends``."""
        out, by_length = {}, {}
        for i in ends:
            by_length.setdefault(min(remembered, i + 1), []).append(i)
        for length, places in by_length.items():
            past = np.array([x[i + 1 - length : i + 1] for i in places])
            omega, alpha, beta = fit_garchs(past)
            h = np.maximum([float((p**2).mean()) for p in past], 1e-18)
            for v in np.ascontiguousarray((past * past).T):
                h = omega + alpha * v + beta * h
            out |= dict(zip(places, zip(omega.tolist(), alpha.tolist(), beta.tolist(), h.tolist())))
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable")
        x, n = rows["ret"].to_numpy(float), rows["n"].to_numpy(np.int64)
        out, fitted, h = np.zeros(len(x)), None, 0.0
        own = np.flatnonzero((rows["tile"] == rows["own"]).to_numpy())
        made = refits(x, own[(n[own] >= 1) & ((n[own] - 1) % refit == 0)].tolist())
        for i in own.tolist():
            if i in made:
                *fitted, h = omega, alpha, beta, _ = made[i]
            elif fitted:
                h = omega + alpha * x[i] * x[i] + beta * h
            out[i] = np.sqrt(h) if fitted else np.std(x[: i + 1], ddof=1) if i else 0.0
        return pd.DataFrame({"symbol": rows["symbol"].to_numpy()[own], "seq": rows["seq"].to_numpy()[own], "sigma": out[own]})

    d = returns.select("symbol", "seq", "ts", "ret")
    # dealt by number: a tile takes far longer than its bytes would say
    tiles = spread(d, lookback=remembered - 1, tile_rows=refit * tile_refits, shift=least - 1, tasks=default_parallelism(returns.sparkSession))
    # rows before the first refit look back on all rows of their symbol, which are fewer than ``least``
    made = Window.partitionBy("symbol", "tile")
    own = tiles.withColumn("__own", F.max(F.col("tile") == F.col("own")).over(made)).where("__own").drop("__own")  # not tiles of copies alone
    return own.groupBy("symbol", "tile").applyInPandas(run, "symbol string, seq long, sigma double")


class RateLimit:
    """Greedy admission: an order passes if fewer than the caps passed in the last second and minute."""

    def __init__(self, per_second: int, per_minute: int, second: float, minute: float):
        self.caps, self.spans, self.passed = (per_second, per_minute), (second, minute), (deque(), deque())

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in (part["ts"].astype("int64") if part["ts"].dtype == "datetime64[us]" else part["ts"].astype("datetime64[us]").astype("int64")).tolist():
            for span, passed in zip(self.spans, self.passed):
                while passed and passed[0] <= t - span * 1e6:
                    passed.popleft()
            ok = all(len(p) < cap for p, cap in zip(self.passed, self.caps))
            if ok:
                for p in self.passed:
                    p.append(t)
            out.append(ok)
        return pd.DataFrame({"symbol": part["symbol"], "seq": part["seq"], "admitted": out})


def rate_limited(orders: DataFrame, per_second: int = 10, per_minute: int = 100, second: float = 1.0, minute: float = 60.0) -> DataFrame:
    """(symbol, seq, admitted) in order of time."""
    return scan(orders.select("symbol", "seq", "ts"), lambda: RateLimit(per_second, per_minute, second, minute), "symbol string, seq long, admitted boolean")
