"""Larger recurrences on evaluation rows: book dynamics, regime transitions, model ensembles, boosted trees."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import Kalman3D, scan


class BookDynamics:
    """An incremental book of ten levels a side, with decaying scores of pulled liquidity and flashed sizes.

    Operation 0 inserts at a level and moves deeper ones down, 1 replaces, 2 deletes and moves deeper ones up.
    """

    DEPTH = 10

    def __init__(self):
        self.sides = {"BID": [None] * self.DEPTH, "ASK": [None] * self.DEPTH}
        self.totals, self.pulled, self.flashed, self.sizes = {"BID": 0.0, "ASK": 0.0}, {"BID": 0.0, "ASK": 0.0}, 0.0, deque(maxlen=100)

    def step(self, operation: int, side: str, level: int, price: float, size: float) -> None:
        book = self.sides[side]
        if operation == 0:
            book.insert(level, (price, size))
            book.pop()
        elif operation == 1:
            book[level] = (price, size)
        elif operation == 2:
            book.pop(level)
            book.append(None)
        for name in self.sides:
            now = sum(x[1] for x in self.sides[name] if x)
            self.pulled[name] *= 0.95
            change = (now - self.totals[name]) / self.totals[name] if self.totals[name] > 0 else 0.0
            if change < -0.15:
                self.pulled[name] -= change
            self.totals[name] = now
        self.flashed *= 0.98
        if operation in (0, 1) and level < 3:
            self.sizes.append(size)
            middle = float(np.median(self.sizes))
            if len(self.sizes) >= 20 and middle > 0 and size > 5 * middle:
                self.flashed += min(1.0, size / (10 * middle))

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part[["operation", "side", "level", "price", "size"]].itertuples(index=False):
            self.step(*row)
            bid, ask = (next((x for x in self.sides[s] if x), (None, None)) for s in ("BID", "ASK"))
            out.append((bid[0], ask[0], self.totals["BID"], self.totals["ASK"], self.pulled["BID"], self.pulled["ASK"], self.flashed))
        frame = pd.DataFrame(out, columns=["bid", "ask", "bid_depth", "ask_depth", "pull_bid", "pull_ask", "spoofing"]).astype("float64")
        return pd.concat([part[["symbol", "seq"]].reset_index(drop=True), frame], axis=1)


def book_dynamics(events: DataFrame) -> DataFrame:
    """``events(symbol, seq, ts, operation, side, level, price, size)`` → best quotes, depths and scores after each."""
    schema = "symbol string, seq long, bid double, ask double, bid_depth double, ask_depth double, pull_bid double, pull_ask double, spoofing double"
    return scan(events.select("symbol", "seq", "ts", "operation", "side", "level", "price", "size"), BookDynamics, schema)


class Transitions:
    """Regime changes scored by an adaptive logit over the size, direction and dynamics of the move.

    The move is scaled by the deviation of the last 200 states; filters of level and entropy advance on changes only;
    the principal plane is refitted every 50 states; features and signal are normalised by moving averages, and the first change has probability one half.
    """

    def __init__(self, cols, weights, threshold=0.45, alpha=0.05):
        self.cols, self.weights, self.threshold, self.alpha = list(cols), np.asarray(weights, float), threshold, alpha
        self.states, self.count, self.was, self.axes, self.logit = deque(maxlen=200), 0, None, None, None
        self.filters = [Kalman3D("x", 1e-8, 1e-5), Kalman3D("x", 1e-6, 1e-3)]

    def _derivatives(self, i: int, value: float) -> tuple[float, float]:
        out = self.filters[i](pd.DataFrame({"symbol": [""], "seq": [0], "x": [value]}))
        return float(out.velocity[0]), float(out.acceleration[0])

    def _probability(self, x: np.ndarray) -> float:
        if self.logit is None:
            self.logit = [x.copy(), np.ones_like(x), 0.0, 1.0]
            return 0.5
        mean, var, s_mean, s_var = self.logit
        deviation = np.sqrt(var + 1e-8)
        prior = np.concatenate([self.weights, np.full(len(x) - len(self.weights), self.weights.mean())])
        w = prior / (deviation + 1e-6)
        signal = float((w / np.abs(w).sum()) @ ((x - mean) / deviation))
        p = 1 / (1 + np.exp(-(signal - s_mean) / np.sqrt(s_var + 1e-8)))
        d, t, a = x - mean, signal - s_mean, self.alpha
        self.logit = [mean + a * d, (1 - a) * var + a * d * d, s_mean + a * t, (1 - a) * s_var + a * t * t]
        return float(p)

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for seq, regime, *state in part[["seq", "regime_id", *self.cols]].itertuples(index=False):
            v = np.array(state, float)
            self.states.append(v)
            self.count += 1
            recent = np.array(self.states)
            if self.count % 50 == 0:
                centred = recent - recent.mean(axis=0)
                self.axes = (recent.mean(axis=0), np.linalg.eigh(centred.T @ centred)[1][:, -2:])
            if self.was is not None and regime != self.was[0]:
                delta = v - self.was[1]
                scale = np.maximum(recent.std(axis=0), 1e-9) if self.count >= 10 else np.ones(len(v))
                heuristic = float(np.tanh((np.abs(delta) / scale) @ self.weights))
                level, entropy = self._derivatives(0, v[0]), self._derivatives(1, v[-1])
                projection = float(np.linalg.norm((v - self.axes[0]) @ self.axes[1])) if self.axes else 0.0
                x = np.array([*np.abs(delta), heuristic, projection, *map(abs, level), *map(abs, entropy)])
                p = self._probability(x)
                out.append((part["symbol"].iloc[0], seq, self.was[0], regime, heuristic, p, p > self.threshold, level[0], level[1]))
            self.was = (regime, v)
        return pd.DataFrame(out, columns=["symbol", "seq", "from_regime", "to_regime", "strength", "probability", "significant", "velocity", "acceleration"])


def regime_transitions(states: DataFrame, cols, weights) -> DataFrame:
    """One row per change of ``regime_id``."""
    schema = "symbol string, seq long, from_regime long, to_regime long, strength double, probability double, significant boolean, velocity double, acceleration double"
    return scan(states.select("symbol", "seq", "ts", "regime_id", *cols), lambda: Transitions(cols, weights), schema)


class Ridge:
    """Online ridge regression by gradient steps on running-normalised features, with forgetting."""

    def __init__(self, d: int, rate=0.001, l2=0.01, forgetting=0.995):
        self.w, self.b, self.mean, self.var, self.n, self.rate, self.l2, self.forgetting, self.x = np.zeros(d), 0.0, np.zeros(d), np.ones(d), 0, rate, l2, forgetting, None

    def predict(self, x: np.ndarray) -> float:
        self.x = (x - self.mean) / np.sqrt(self.var + 1e-8)
        return float(self.w @ self.x) + self.b

    def learn(self, error: float) -> None:
        step = 2 * self.rate / (1 + 0.001 * self.n)
        self.w = (self.w - step * (self.l2 * self.w - error * self.x)) * self.forgetting
        self.b += step * error
        d = self.x - self.mean
        self.mean, self.var = (self.x.copy(), np.ones(len(d))) if self.n == 0 else (self.mean + 0.01 * d, 0.99 * self.var + 0.01 * d * d)
        self.n += 1


class Ensemble:
    """A ridge for all rows, one for each of up to ten regimes (the least used goes), and a momentum rule, weighed by 1 / mean absolute error."""

    def __init__(self, cols, target, momentum, least=50, decay=0.98):
        self.cols, self.target, self.momentum, self.least, self.decay = list(cols), target, momentum, least, decay
        d = len(self.cols)
        self.ridge, self.by_regime = Ridge(d), {}
        self.weights, self.errors, self.n = np.full(3, 1 / 3), [deque(maxlen=100) for _ in range(3)], 0

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        features = part[self.cols].to_numpy(np.float64)
        for x, regime, momentum, y in zip(features, part["regime_id"].tolist(), part[self.momentum].tolist(), part[self.target].tolist()):
            if regime not in self.by_regime:
                if len(self.by_regime) >= 10:
                    del self.by_regime[min(self.by_regime, key=lambda k: self.by_regime[k].n)]
                self.by_regime[regime] = Ridge(len(x))
            own = self.by_regime[regime]
            guesses = np.array([self.ridge.predict(x), own.predict(x), 0.1 * momentum])
            ready = self.n >= self.least
            prediction = float(self.weights @ guesses) if ready else float(guesses.mean())
            out.append((prediction, float(guesses.std()), *self.weights))
            for errors, guess in zip(self.errors, guesses):
                errors.append(abs(y - guess))
            self.ridge.learn(y - guesses[0])
            own.learn(y - guesses[1])
            self.n += 1
            if self.n >= self.least:
                inverse = np.array([1 / max(float(np.mean(e)), 1e-10) if len(e) >= 10 else 1.0 for e in self.errors])
                self.weights = self.decay * self.weights + (1 - self.decay) * inverse / inverse.sum()
        frame = pd.DataFrame(out, columns=["prediction", "disagreement", "w_ridge", "w_regime", "w_momentum"])
        return pd.concat([part[["symbol", "seq"]].reset_index(drop=True), frame], axis=1)


def ensemble_predictions(rows: DataFrame, cols, target: str, momentum: str) -> DataFrame:
    """(symbol, seq, prediction, disagreement, w_ridge, w_regime, w_momentum); each row is predicted before it is learned."""
    schema = "symbol string, seq long, prediction double, disagreement double, w_ridge double, w_regime double, w_momentum double"
    extra = [c for c in (momentum, target) if c not in cols]
    return scan(rows.select("symbol", "seq", "ts", "regime_id", *cols, *extra), lambda: Ensemble(cols, target, momentum), schema)


def boosted_trees(rows: DataFrame, cols, target: str, cut: str, rounds: int = 100) -> DataFrame:
    """Boosted trees fitted on the rows where ``cut`` holds: the others with ``prediction``, or none if they do not beat their own variance."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(rows.where(F.col(target).isNotNull()))
    model = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, seed=42).fit(data.where(cut))
    scored = model.transform(data.where(f"NOT ({cut})")).drop("features")
    fit = scored.agg(F.avg((F.col(target) - F.col("prediction")) ** 2).alias("mse"), F.var_pop(target).alias("var"))
    return scored.join(F.broadcast(fit.where("mse < var").select("mse")))  # one row or none
