"""Portfolio risk: marks, exposure and leverage checks, budgets by risk regime, alerts, the whole kill switch, books."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .carried import exponential_mean, last_known
from .scans import scan
from .tiles import spread, tiled
from .windows import SYMBOL, last, ordered, so_far

#: Limits of each risk regime, from the calmest on: gross, net, share of one position, value at risk, drawdown, size multiplier.
BUDGETS = (
    ("NORMAL", 10_000_000.0, 5_000_000.0, 0.30, 0.02, 0.10, 1.0),
    ("ELEVATED", 7_500_000.0, 3_500_000.0, 0.25, 0.015, 0.07, 0.75),
    ("STRESSED", 5_000_000.0, 2_000_000.0, 0.20, 0.01, 0.05, 0.50),
    ("CRISIS", 2_500_000.0, 1_000_000.0, 0.15, 0.005, 0.03, 0.25),
)


def budgets(spark: SparkSession) -> DataFrame:
    """Four rows: (risk_regime, max_gross, max_net, max_single, max_var, max_fall, size_multiplier)."""
    return spark.createDataFrame(BUDGETS, "risk_regime string, max_gross double, max_net double, max_single double, max_var double, max_fall double, size_multiplier double")


def mark_prices(df: DataFrame, tile_rows: int = 10_000, positive: bool = True) -> DataFrame:
    """``mark, mark_ret``: the mid of the last known bid and ask if they do not cross, else the price; its log return.

    Quotes that are null, and unless ``positive`` is false those not above 0, leave the known ones.
    """
    known = {f"known_{c}": F.when(F.col(c) > 0, F.col(c)) if positive else F.col(c) for c in ("bid", "ask")}
    rows = last_known(spread(df, lookback=1, tile_rows=tile_rows), known)
    bid, ask = F.col("known_bid"), F.col("known_ask")
    rows = rows.withColumn("mark", F.when(ask >= bid, (bid + ask) / 2).otherwise(F.col("price")))
    was = F.lag("mark").over(Window.partitionBy("symbol", "tile").orderBy("n"))
    marked = rows.withColumn("mark_ret", F.when((was > 0) & (F.col("mark") > 0), F.log(F.col("mark") / was)))
    return marked.where("tile = own").drop("tile", "own", "n", "known_bid", "known_ask")


def pretrade_reason(notional: Column, gross: Column, net: Column, var: Column, fall: Column) -> Column:
    """First budget that a proposal of a signed notional breaks, or OK; the budget's columns stand beside the portfolio's."""
    size = F.abs(notional)
    share = size / F.greatest(gross + size, F.lit(1.0))
    return (
        F.when(gross + size > F.col("max_gross"), "GROSS")
        .when(F.abs(net + notional) > F.col("max_net"), "NET")
        .when((gross > 0) & (share > F.col("max_single")), "CONCENTRATION")
        .when(var > F.col("max_var"), "VAR")
        .when(fall > F.col("max_fall"), "DRAWDOWN")
        .otherwise("OK")
    )


def risk_level(vol_ratio: Column, fall: Column) -> Column:
    """Risk regime from the ratio of volatility to its mean and from the drawdown, the worse of the two."""
    by_vol = F.when(vol_ratio > 3, 3).when(vol_ratio > 2, 2).when(vol_ratio > 1.5, 1).otherwise(0)
    by_fall = F.when(fall > 0.07, 3).when(fall > 0.05, 2).when(fall > 0.03, 1).otherwise(0)
    return F.get(F.array(*(F.lit(b[0]) for b in BUDGETS)), F.greatest(by_vol, by_fall))


def equity_path(daily: DataFrame, start: float) -> DataFrame:
    """``equity, peak, ret, vol, vol_ratio`` of ``daily(day, pnl)``, one row a day: the deviation of the last 20 returns (10 at least) over its mean so far."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as days
    d = daily.withColumn("equity", F.lit(start) + F.sum("pnl").over(w))
    d = d.withColumn("ret", F.col("pnl") / (F.col("equity") - F.col("pnl")))
    d = d.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(w)))
    recent = Window.orderBy("day").rowsBetween(-19, 0)
    d = d.withColumn("vol", F.when(F.count("ret").over(w) >= 10, F.stddev_pop("ret").over(recent)))
    return d.withColumn("vol_ratio", F.col("vol") / F.avg("vol").over(w))


def snapshot(path: DataFrame, positions: DataFrame, rho: DataFrame) -> DataFrame:
    """One row of portfolio risk: equity, drawdown, values at risk in money, exposure, concentration, regime, use of its budget.

    ``path`` is that of ``equity_path``, ``positions(symbol, position, mark)``, ``rho(avg_correlation)`` one row.
    Values at risk need 20 days, else they are 0; they are never negative.
    """
    at = path.agg(*(F.max_by(c, "day").alias(c) for c in ("equity", "peak", "vol", "vol_ratio")), F.count("*").alias("days"), F.percentile("ret", F.lit(0.05)).alias("q95"), F.percentile("ret", F.lit(0.01)).alias("q99"))
    tail = path.crossJoin(F.broadcast(at.select("q95"))).where("ret <= q95").agg(F.avg("ret").alias("tail"))  # one row
    value = F.col("position") * F.col("mark")
    held = positions.agg(
        F.sum(F.when(value > 0, value).otherwise(0.0)).alias("long"), F.sum(F.when(value <= 0, -value).otherwise(0.0)).alias("short"), F.max(F.abs(value)).alias("largest"), F.sum(F.abs(value)).alias("gross"), F.sum(value).alias("net")
    )
    one = at.crossJoin(F.broadcast(tail)).crossJoin(F.broadcast(held)).crossJoin(F.broadcast(rho))  # one row each
    money = lambda q: F.when(F.col("days") < 20, 0.0).otherwise(F.greatest(F.lit(0.0), -F.col(q) * F.col("equity")))
    fall = F.greatest(F.lit(0.0), (F.col("peak") - F.col("equity")) / F.col("peak"))
    one = one.withColumns({"var_95": money("q95"), "var_99": money("q99"), "cvar_95": money("tail"), "fall": fall, "risk_regime": risk_level(F.col("vol_ratio"), fall)})
    one = one.join(F.broadcast(budgets(path.sparkSession)), "risk_regime")  # four rows
    return one.select(
        "equity", "fall", (F.col("fall") / F.greatest("vol", F.lit(1e-6))).alias("fall_by_vol"), "var_95", "var_99", "cvar_95", "long", "short", "gross", "net", "risk_regime", "size_multiplier",
        (F.col("gross") / F.col("max_gross")).alias("budget_used"), F.when(F.col("gross") > 0, F.col("largest") / F.col("gross")).otherwise(0.0).alias("concentration"), "avg_correlation",
    )


def gross_after(gross: Column, held: Column, notional: Column, eps: float = 0.01) -> Column:
    """Gross exposure if a signed notional is added to what is held of one instrument; less than ``eps`` left counts as none."""
    left = held + notional
    return gross - F.abs(held) + F.when(F.abs(left) < eps, 0.0).otherwise(F.abs(left))


def alert_level(fall: Column, warning: float = 0.05, critical: float = 0.10) -> Column:
    return F.when(fall >= critical, "CRITICAL").when(fall >= warning, "WARNING")


class Cooldown:
    """Fires the first alert and then each that comes at least ``seconds`` after the last that fired."""

    def __init__(self, seconds: float):
        self.seconds, self.last = seconds, None

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        fired = []
        for at in part["at"].tolist():
            go = self.last is None or at - self.last >= self.seconds
            fired.append(go)
            if go:
                self.last = at
        return part.assign(fired=fired)


def cooled(alerts: DataFrame, seconds: float = 60.0) -> DataFrame:
    """``fired`` for ``alerts(source, at, seq, level)``: a source is silent for ``seconds`` after each alert that fires."""
    schema = "source string, at double, seq long, level string, fired boolean"
    return scan(alerts.select("source", "at", "seq", "level"), lambda: Cooldown(seconds), schema, key="source", order=("at", "seq"))


class AlertCap:
    """Fires an alert if its kind has been silent for ``seconds`` and fewer than ``most`` of all kinds fired within ``window`` seconds."""

    def __init__(self, seconds: float, most: int, window: float):
        self.seconds, self.most, self.window, self.last, self.fired = seconds, most, window, {}, deque()

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, at in zip(part["kind"].tolist(), part["at"].tolist()):
            while self.fired and self.fired[0] <= at - self.window:
                self.fired.popleft()
            go = at - self.last.get(kind, float("-inf")) >= self.seconds and len(self.fired) < self.most
            out.append(go)
            if go:
                self.last[kind] = at
                self.fired.append(at)
        return part.assign(fired=out)


def capped(alerts: DataFrame, seconds: float = 60.0, most: int = 20, window: float = 3600.0) -> DataFrame:
    """``fired`` for ``alerts(channel, at, seq, kind)``: a pause after each alert of a kind, and a cap on all of a channel in any hour."""
    schema = "channel string, at double, seq long, kind string, fired boolean"
    return scan(alerts.select("channel", "at", "seq", "kind"), lambda: AlertCap(seconds, most, window), schema, key="channel", order=("at", "seq"))


def halts(
    rows: DataFrame,
    alpha: float = 0.1,
    warm_up: int = 50,
    exempt: int = 10,
    floor: float = 0.3,
    most_slippage: float = 0.02,
    most_fall: float = 0.1,
    least_cvar: float = -0.05,
    key: str = "symbol",
    order=("ts", "seq"),
) -> DataFrame:
    """``reason, halted`` and ``since``: why and since which row number trading is stopped; it stays stopped.

    ``rows`` have confidence, slippage, fall, cvar and since_transition. In order: the exponential mean of the
    confidence below ``floor`` (not before ``warm_up`` rows, nor within ``exempt`` rows of a regime change), slippage,
    drawdown, tail loss.
    """
    d = exponential_mean(tiled(rows, key=key, order=order), "confidence", 1 - alpha, "ema", key=key)
    trusted = F.when(F.col("n") < warm_up, F.lit(floor)).when(F.col("since_transition") < exempt, F.greatest("ema", F.lit(floor + 0.05))).otherwise(F.col("ema"))
    found = (
        F.when(trusted < floor, "CONFIDENCE")
        .when(F.col("slippage") > most_slippage, "SLIPPAGE")
        .when(F.col("fall") > most_fall, "DRAWDOWN")
        .when((F.col("cvar") < least_cvar) & (F.col("cvar") < 0), "TAIL_LOSS")
    )
    # the first row that halts a symbol, then a join: no window over the symbol
    first = d.withColumn("__found", found).where("__found IS NOT NULL").groupBy(key).agg(F.min_by("__found", "n").alias("__reason"), F.min("n").alias("__since"))
    stopped = F.col("n") >= F.col("__since")
    d = d.join(first, key, "left").withColumns({"reason": F.when(stopped, F.col("__reason")), "since": F.when(stopped, F.col("__since"))})
    return d.withColumn("halted", F.col("reason").isNotNull()).drop("__reason", "__since", "tile")


def staleness(df: DataFrame, aging: float, stale: float, silent: float, dead: float, keys=SYMBOL) -> DataFrame:
    """``state``: what the pause after each row comes to: FRESH, AGING, STALE, ALERT or KILL; ``safe`` from 20 rows on while not stale."""
    w = ordered(keys)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    pause = F.lead(at).over(w) - at
    df = df.withColumn("pause", pause)
    state = F.when(F.col("pause") > dead, "KILL").when(F.col("pause") > silent, "ALERT").when(F.col("pause") > stale, "STALE").when(F.col("pause") > aging, "AGING").otherwise("FRESH")
    return df.withColumn("state", state).withColumn("safe", (F.row_number().over(w) >= 20) & ~F.coalesce(F.col("pause") > stale, F.lit(False)))


def best_first(side: Column, buy: bool) -> Column:
    """Levels struct(price, size) that an order meets, best first: asks by rising price for a buy, bids by falling price for a sale."""
    ranked = F.array_sort(F.filter(side, lambda level: (level["price"] > 0) & (level["price"] < float("inf"))))
    return ranked if buy else F.reverse(ranked)


def liquidity_at(side: Column, price: Column, buy: bool) -> Column:
    """Total size of the levels that a limit price crosses."""
    crosses = lambda level: level["price"] <= price if buy else level["price"] >= price
    return F.aggregate(F.filter(side, crosses), F.lit(0.0), lambda s, level: s + level["size"])


def with_book(rows: DataFrame, tile_rows: int = 10_000) -> DataFrame:
    """``spread, imbalance, pressure, liquid`` of each row from the last book snapshot so far, else from its own best quotes.

    ``rows`` have ``bids`` and ``asks`` (arrays of price and size, null between snapshots). A book with a side missing
    does not count.
    """
    whole = (F.size("bids") > 0) & (F.size("asks") > 0)
    rows = last_known(tiled(rows, tile_rows), {"book": F.when(whole, F.struct("bids", "asks"))}).withColumnRenamed("book", "__book").drop("n", "tile")
    b, a = best_first(F.col("__book.bids"), False), best_first(F.col("__book.asks"), True)
    rows = rows.withColumns({"__b": b, "__a": a})
    depth = lambda side: F.aggregate(side, F.lit(0.0), lambda s, level: s + level["size"])
    weighted = lambda side: F.aggregate(F.transform(side, lambda level, i: level["size"] / (1 + i)), F.lit(0.0), lambda s, x: s + x)
    best_bid, best_ask = F.get(F.col("__b"), F.lit(0))["price"], F.get(F.col("__a"), F.lit(0))["price"]
    from_book = F.struct(
        F.greatest(F.lit(0.0), best_ask - best_bid).alias("spread"),
        ((depth(F.col("__b")) - depth(F.col("__a"))) / (depth(F.col("__b")) + depth(F.col("__a")))).alias("imbalance"),
        ((weighted(F.col("__b")) - weighted(F.col("__a"))) / (weighted(F.col("__b")) + weighted(F.col("__a")))).alias("pressure"),
        ((best_ask - best_bid) / ((best_ask + best_bid) / 2) * 10_000 < 50).alias("liquid"),
    )
    bid, ask = F.coalesce("bid", F.col("price") - 0.01), F.coalesce("ask", F.col("price") + 0.01)
    sizes = F.coalesce("bid_size", F.lit(0.0)) + F.coalesce("ask_size", F.lit(0.0))
    imbalance = F.when(sizes > 0, (F.coalesce("bid_size", F.lit(0.0)) - F.coalesce("ask_size", F.lit(0.0))) / sizes).otherwise(0.0)
    from_quotes = F.struct(F.greatest(F.lit(0.0), ask - bid).alias("spread"), imbalance.alias("imbalance"), F.lit(0.0).alias("pressure"), F.lit(True).alias("liquid"))
    rows = rows.withColumn("__state", F.when(F.col("__book").isNotNull(), from_book).otherwise(from_quotes))
    return rows.select(*(c for c in rows.columns if not c.startswith("__")), "__state.*")


def tail_warning(kurt: Column, alpha: Column, cvar: Column) -> Column:
    """Words for heavy tails, joined by `` | ``; null without any."""
    words = F.array_compact(F.array(F.when(kurt > 5, "High kurtosis"), F.when(alpha < 2.5, "Low tail slope"), F.when(cvar < -0.05, "Severe CVaR")))
    return F.when(F.size(words) > 0, F.array_join(words, " | "))


def health(df: DataFrame, latency: str, failed: Column, budget: float, most_errors: float, n: int = 1000, keys=SYMBOL) -> DataFrame:
    """``mean_latency, error_rate, healthy`` of the last n rows."""
    w = last(n, keys)
    df = df.withColumns({"mean_latency": F.avg(latency).over(w), "error_rate": F.avg(F.when(failed, 1.0).otherwise(0.0)).over(w)})
    return df.withColumn("healthy", (F.col("mean_latency") <= budget) & (F.col("error_rate") <= most_errors))
