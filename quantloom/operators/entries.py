"""The way into and out of a position: eligibility, direction, confirmation, stops, sizing, and what the journal of trades allows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship_package
from .scans import scan
from .tiles import rolling
from .windows import SYMBOL, last, ordered, so_far

TRADE_ORDER = ("ts", "order_id", "line", "pnl")


def ineligible(transition: Column, risk_ok: Column, sigma: Column, entropy: Column) -> Column:
    """Why no entry is looked at: no transition, risk, or an invalid state; null if one is."""
    return (
        F.when(~F.coalesce(transition, F.lit(False)), "NO_TRANSITION")
        .when(~risk_ok, "RISK")
        .when((sigma <= 0) | (entropy == float("-inf")), "INVALID_STATE")
    )


def composite_inputs(df: DataFrame) -> DataFrame:
    """``order_flow, momentum, reversion, orderbook`` from ofi_z, mom_50, mean_rev, pressure and imbalance, each about in [-1, 1]."""
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return df.withColumns(
        {
            "order_flow": clip(F.col("ofi_z") * 0.3),
            "momentum": F.col("mom_50"),
            "reversion": -F.col("mean_rev") * 0.1,
            "orderbook": clip(F.col("pressure") * 0.7 + F.col("imbalance") * 0.3),
        }
    )


def interactions(df: DataFrame) -> DataFrame:
    """Five products of features and the flag of fat tails (a tail slope above 0.333)."""
    product = lambda a, b: F.col(a) * F.col(b)
    return df.withColumns(
        {
            "vpin_spread": product("vpin", "spread_frac"),
            "kyle_confidence": product("kyle", "confidence"),
            "amihud_vol_of_vol": product("amihud", "vol_of_vol"),
            "ofi_pressure": product("ofi_sum", "pressure"),
            "vpin_kyle": product("vpin", "kyle"),
            "fat_tail": F.when(F.col("tail_slope") > 0.333, 1.0).otherwise(0.0),
        }
    )


def direction_rule(ofi_z: Column, seen: Column, direction: Column, channels: list[Column], actionable: float = 0.15) -> Column:
    """struct(action, reason, strength): against an extreme order flow imbalance, else with a composite that two channels share; null if neither.

    ``seen`` counts the imbalances so far; 50 are needed. The composite needs a strength above 0.2.
    """
    extreme = (F.abs(ofi_z) > 2) & (seen >= 50)
    agreeing = sum((F.when(((c > 0) == (direction > 0)) & (F.abs(c) > 0.001), 1).otherwise(0) for c in channels), F.lit(0))
    strength = F.abs(direction)
    shared = (strength >= actionable) & (strength > 0.20) & (agreeing >= 2)
    fade = F.struct(F.when(ofi_z > 0, "SELL").otherwise("BUY").alias("action"), F.lit("ORDER_FLOW").alias("reason"), F.least(F.lit(1.0), F.abs(ofi_z) / 3).alias("strength"))
    follow = F.struct(F.when(direction > 0, "BUY").otherwise("SELL").alias("action"), F.lit("COMPOSITE").alias("reason"), strength.alias("strength"))
    return F.when(extreme, fade).when(shared, follow)


def confirmed(df: DataFrame, signal: str, windows: int, regime: str = "regime_id", keys=SYMBOL) -> DataFrame:
    """``outcome`` of each row with a signal: CONFIRMED if the regime stays for so many rows after it, ABORTED if it changes, else PENDING.

    Each signal is judged by itself; ``confirmed_at`` is the number of the row that confirms it.
    """
    w = ordered(keys)
    df = df.withColumn("__n", F.row_number().over(w))
    ahead = [F.lead(regime, i).over(w) for i in range(1, windows + 1)]
    changed = F.lit(False)
    for x in ahead:
        changed = changed | F.coalesce(x != F.col(regime), F.lit(False))
    outcome = F.when(changed, "ABORTED").when(ahead[-1].isNotNull(), "CONFIRMED").otherwise("PENDING")
    df = df.withColumn("outcome", F.when(F.col(signal).isNotNull(), outcome))
    return df.withColumn("confirmed_at", F.when(F.col("outcome") == "CONFIRMED", F.col("__n") + windows)).drop("__n")


def edge_decay(df: DataFrame, stable: float, ticks: int = 2, tile_rows: int = 10_000) -> DataFrame:
    """``decay``: why the edge of an open ``side`` is gone, or null: the divergence collapsed, the move against it speeds up
    again, or the entropy has risen for ``ticks`` rows.

    Rows have divergence, velocity, acceleration and entropy_velocity. The entropy's streak counts only rows that no
    rule before it ends, so ``ticks`` of these in a row decide, tile by tile of their own.
    """
    against = F.when(F.col("side") == "BUY", (F.col("velocity") < 0) & (F.col("acceleration") < 0)).otherwise((F.col("velocity") > 0) & (F.col("acceleration") > 0))
    df = df.withColumn("decay", F.when(F.col("divergence") < stable, "COLLAPSED").when(against, "REACCELERATED"))
    rising = F.when(F.col("entropy_velocity") > 0, 1).otherwise(0)
    risen = lambda d, keys: d.withColumn("decay", F.when(F.sum(rising).over(last(ticks, keys)) == ticks, "ENTROPY_RISES"))
    judged = rolling(df.where("decay IS NULL"), ticks - 1, risen, tile_rows).drop("n")
    return judged.unionByName(df.where("decay IS NOT NULL"))


def stop_reason(ret: Column, stop: Column, notional: Column, hard: float = 2.0, least_money: float = 5.0) -> Column:
    """Which stop a return on the entry price hits: of money, of the tick, or hard; null if none."""
    lost = F.abs(ret) * notional
    most = F.greatest(F.lit(least_money), notional * stop * hard)
    money = (ret < 0) & (lost >= most)
    return F.when(money & (ret > -stop), "MONEY_STOP").when((ret <= -stop) & (ret > -stop * hard), "TICK_STOP").when((ret <= -stop) | money, "HARD_STOP")


STOPS = "symbol string, k long, side string, stop_k long, reason string, mae double, mfe double"


def tick_stops(entries: DataFrame, marks: DataFrame, hold: int, hard: float = 2.0, least_money: float = 5.0, tile_rows: int = 10_000) -> DataFrame:
    """First stop of each entry within ``hold`` rows, with its worst and best return until then: (symbol, k, side, stop_k, reason, mae, mfe).

    ``entries(symbol, k, price, side, qty, stop)`` and ``marks(symbol, k, price)`` number the rows of a symbol. The
    entries of a tile of numbers meet its marks and the ``hold`` marks after it, so no entry is sent more than once.
    The rules are those of ``stop_reason``.
    """
    ship_package(marks.sparkSession)
    tile = F.floor((F.col("k") - 1) / tile_rows)
    earlier = [F.when((F.col("k") <= (tile + 1 - d) * tile_rows + hold) & (tile >= d), tile - d) for d in range(1, -(-hold // tile_rows) + 1)]
    m = marks.select("symbol", "k", F.col("price").cast("double").alias("price"), F.explode(F.array_compact(F.array(tile, *earlier))).alias("tile"))
    e = entries.select(F.col("symbol").alias("symbol"), F.col("k").alias("k"), F.col("price").cast("double").alias("price"), "side", F.col("qty").cast("double").alias("qty"), F.col("stop").cast("double").alias("stop"), tile.alias("tile"))
    names = [c.split()[0] for c in STOPS.split(", ")]

    def run(entered: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        seen = seen.sort_values("k", kind="stable")
        numbers, out = seen["k"].to_numpy(np.int64), []
        ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([seen["price"].to_numpy(float), np.full(hold, np.nan)]), hold)
        number = np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, np.full(hold, np.iinfo(np.int64).max)]), hold)
        for low in range(0, len(entered), 2000):
            part = entered.iloc[low : low + 2000]
            at = np.searchsorted(numbers, part["k"].to_numpy(np.int64), side="right")
            price, stop, qty = (part[c].to_numpy(float)[:, None] for c in ("price", "stop", "qty"))
            near = number[at] <= part["k"].to_numpy(np.int64)[:, None] + hold
            path = np.where(near, ahead[at], np.nan)
            buy = (part["side"] == "BUY").to_numpy()[:, None]
            with np.errstate(all="ignore"):
                ret = np.where(buy, path / price - 1, 1 - path / price)
                notional = price * np.abs(qty)
                money = (ret < 0) & (np.abs(ret) * notional >= np.maximum(least_money, notional * stop * hard))
                hit = money | (ret <= -stop)
            found = np.flatnonzero(hit.any(axis=1))
            if not len(found):
                continue
            first = hit[found].argmax(axis=1)
            here, limit = ret[found, first], stop[found, 0]
            reason = np.where(money[found, first] & (here > -limit), "MONEY_STOP", np.where((here <= -limit) & (here > -limit * hard), "TICK_STOP", "HARD_STOP"))
            went = np.where(np.arange(hold)[None, :] <= first[:, None], ret[found], np.nan)
            columns = (part["symbol"].to_numpy()[found], part["k"].to_numpy()[found], part["side"].to_numpy()[found], number[at][found, first], reason, np.minimum(0.0, np.nanmin(went, axis=1)), np.maximum(0.0, np.nanmax(went, axis=1)))
            out.append([np.asarray(c, object) for c in columns])
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))) if out else {c: np.empty(0, object) for c in names}, dtype=object)

    schema = STOPS.replace("symbol string", f"symbol {marks.schema['symbol'].dataType.simpleString()}", 1)
    return e.groupBy("symbol", "tile").cogroup(m.groupBy("symbol", "tile")).applyInPandas(run, schema)


def entry_order(held: Column, action: Column, size: Column, calibrated: Column, live: Column) -> Column:
    """struct(decision, close_qty, qty): what an entry signal makes of the position held.

    A position in the same direction is left alone; an opposite one is closed first. Half the size is taken while the
    impact model is not calibrated; live orders are whole numbers of at least one, others at least 0.1.
    """
    same = ((held > 0) & (action == "BUY")) | ((held < 0) & (action == "SELL"))
    qty = size * F.when(calibrated, 1.0).otherwise(0.5)
    qty = F.when(live, F.greatest(F.lit(1.0), F.rint(qty))).otherwise(F.greatest(F.lit(0.1), qty))
    decision = F.when(action.isNull(), "NONE").when(same, "KEEP").when(held != 0, "REVERSE").otherwise("OPEN")
    enters = decision.isin("REVERSE", "OPEN")
    return F.struct(decision.alias("decision"), F.when(decision == "REVERSE", F.abs(held)).otherwise(0.0).alias("close_qty"), F.when(enters, qty).otherwise(0.0).alias("qty"))


def legacy_size(strength: Column, tail: Column, kelly: Column, dwell: Column, kelly_scale: float = 0.5, base: float = 1.0, least_variance: float = 0.5, dwell_norm: float = 50.0, most: float = 3.0) -> Column:
    """Quantity without an equity: a base scaled by Kelly's share, strength over variance, and the log of the dwell time.

    A null dwell time stands for half the strength above a half.
    """
    share = F.greatest(F.lit(0.1), F.least(F.lit(2.0), kelly * kelly_scale * 10))
    variance = F.greatest(F.lit(least_variance), tail / 2)
    time = F.when(dwell.isNull(), 0.5 + strength * 0.5).otherwise(F.log1p(F.when(dwell > 0, dwell).otherwise(100.0) / dwell_norm))
    return F.greatest(F.lit(0.0), F.least(F.lit(base * most), base * share * strength / F.greatest(variance, F.lit(1e-6)) * time))


def bootstrapped(velocity: Column, sigma: Column, regime: Column, flat: Column, seen: Column, threshold: float = 0.5, scale: float = 0.5) -> Column:
    """Strength of a transition made up from the trend's velocity while there is no position, or null."""
    ready = flat & (sigma > 0) & (regime != -1) & (seen > 100)
    return F.when(ready & (F.abs(velocity) > threshold * sigma), F.least(F.lit(1.0), F.abs(velocity) / sigma * scale))


class Sizing:
    """The multiplier of a journal: down with three losses in a row or more, up by a tenth while the last 50 trades are fair."""

    def __init__(self):
        self.multiplier = 1.0

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for losses, win_rate, factor in zip(part["losses"].tolist(), part["win_rate"].tolist(), part["factor"].tolist()):
            if losses >= 3:
                self.multiplier = max(0.25, 1.0 - losses * 0.15)
            elif win_rate > 0.3 and factor > 0.5:
                self.multiplier = min(1.0, self.multiplier + 0.1)
            out.append(self.multiplier)
        return part.assign(multiplier=out)


def journal(trades: DataFrame, n: int = 50) -> DataFrame:
    """``win_rate, factor, losses, pause, multiplier`` after each of ``trades(symbol, ts, order_id, line, pnl)``.

    Win rate and profit factor of the last n trades, losses in a row, whether trading pauses (ten trades, a win rate
    under 0.1 and a factor under 0.05) and the sizing multiplier. A profit of 0 is a loss.
    """
    w = Window.partitionBy("symbol").orderBy(*TRADE_ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    recent = w.rowsBetween(1 - n, 0)
    won = F.col("pnl") > 0
    d = trades.select("symbol", *TRADE_ORDER).withColumn("__n", F.row_number().over(w))
    d = d.withColumn("losses", F.col("__n") - F.coalesce(F.max(F.when(won, F.col("__n"))).over(run), F.lit(0)))
    lost = -F.sum(F.when(won, 0.0).otherwise(F.col("pnl"))).over(recent)
    d = d.withColumns(
        {
            "win_rate": F.avg(F.when(won, 1.0).otherwise(0.0)).over(recent),
            "factor": F.sum(F.when(won, F.col("pnl")).otherwise(0.0)).over(recent) / F.greatest(lost, F.lit(1e-10)),
        }
    )
    d = d.withColumn("pause", (F.least(F.col("__n"), F.lit(n)) >= 10) & (F.col("win_rate") < 0.1) & (F.col("factor") < 0.05)).drop("__n")
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in d.columns) + ", multiplier double"
    return scan(d, Sizing, schema, order=TRADE_ORDER)


def skipped_regimes(trades: DataFrame, by: tuple[str, ...] = ("symbol", "regime_id"), lost_at_once: float = -5.0, lost: float = -2.5, n: int = 10) -> DataFrame:
    """Why a regime of each account is left out: (by, n, total, reason); null reason if it is not.

    A total below ``lost_at_once``; below ``lost`` from two trades on; or the last n trades win under half and lose on average.
    """
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in TRADE_ORDER))
    d = trades.withColumn("__back", F.row_number().over(w))
    recent = F.col("__back") <= n
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("pnl").alias("total"), F.avg(F.when(recent, F.when(F.col("pnl") > 0, 1.0).otherwise(0.0))).alias("win_rate"), F.avg(F.when(recent, F.col("pnl"))).alias("mean")
    )
    reason = F.when(F.col("total") < lost_at_once, "LOST_AT_ONCE").when(F.col("n") < 2, None).when(F.col("total") < lost, "LOST").when((F.col("win_rate") < 0.5) & (F.col("mean") < 0), "UNPROFITABLE")
    return g.select(*by, "n", "total", reason.alias("reason"))
