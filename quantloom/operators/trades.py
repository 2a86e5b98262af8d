"""Exits, kill switch and regimes of open trades: automata whose state a window can carry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship_package
from .ranks import rank_correlation
from .tiles import spread
from .windows import SYMBOL, ordered, so_far


EXITS = "symbol string, k long, side string, exit_k long, reason string, ret double"
JOURNAL = f"{EXITS}, entry_price double, exit_price double, best double, worst double, low double, high double"


def exits(marks: DataFrame, hold: int = 80, activation=0.6, tight=0.5, normal=0.7, tile_rows: int = 10_000) -> DataFrame:
    """First exit of each entry: (symbol, k, side, exit_k, reason, ret); k numbers a symbol's rows; see ``_paths``."""
    return _paths(marks, hold, activation, tight, normal, tile_rows).select(*(c.split()[0] for c in EXITS.split(", ")))


def exit_journal(marks: DataFrame, hold: int = 80, activation=0.6, tight=0.5, normal=0.7, tile_rows: int = 10_000) -> DataFrame:
    """A journal row for each exit, of one unit: prices, profit (fees are not known here, so gross is net), what the position went through, and how much of it was kept.

    ``best_pct, worst_pct`` are the best and worst unrealised shares after the entry, 0 at least and at most;
    ``mfe_pct, mae_pct`` their sizes, ``mfe_price, mae_price`` the best and worst prices; ``edge_captured`` is the
    realised share over ``mfe_pct``, 0 where that is 0.
    """
    d = _paths(marks, hold, activation, tight, normal, tile_rows)
    buy = F.col("side") == "BUY"
    gross = F.when(buy, F.col("exit_price") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("exit_price"))
    mfe = F.greatest(F.lit(0.0), F.col("best"))
    return d.select(
        "symbol", F.col("k").alias("entry_k"), "exit_k", "side", "entry_price", "exit_price", gross.alias("gross_pnl"), gross.alias("net_pnl"), F.lit(0.0).alias("fees"), F.col("reason").alias("exit_reason"),
        (F.col("exit_k") - F.col("k")).alias("hold_rows"), mfe.alias("best_pct"), F.least(F.lit(0.0), F.col("worst")).alias("worst_pct"), F.greatest(F.lit(0.0), -F.col("worst")).alias("mae_pct"), mfe.alias("mfe_pct"),
        F.when(buy, F.col("low")).otherwise(F.col("high")).alias("mae_price"), F.when(buy, F.col("high")).otherwise(F.col("low")).alias("mfe_price"), F.when(mfe > 0, gross / F.col("entry_price") / mfe).otherwise(0.0).alias("edge_captured"),
    )


def _paths(marks: DataFrame, hold: int, activation: float, tight: float, normal: float, tile_rows: int) -> DataFrame:
    """First exit of each entry with what its path went through.

    ``marks(symbol, ts, seq, price, side, stop, take_profit, trail)``: rows with a side are entries, which follow the
    next ``hold`` rows. In order of precedence: stop loss; trailing stop, armed at a share of the take profit and
    tighter from 1.5 times it on; take profit; longest hold. Each tile brings the rows after it that its entries need.
    """
    ship_package(marks.sparkSession)
    order = ("STOP_LOSS", "TRAILING_STOP", "TAKE_PROFIT", "MAX_HOLD")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable").reset_index(drop=True)
        price = np.concatenate([rows["price"].to_numpy(float), np.full(hold, np.nan)])
        ahead = np.lib.stride_tricks.sliding_window_view(price[1:], hold)
        entries = rows.index[(rows["tile"] == rows["own"]) & rows["side"].notna()].to_numpy()
        out = []
        for low in range(0, len(entries), 2000):
            at = entries[low : low + 2000]
            e = rows.iloc[at]
            path, start = ahead[at], e["price"].to_numpy(float)[:, None]
            long = (e["side"] == "BUY").to_numpy()[:, None]
            stop, take, trail = (e[c].to_numpy(float)[:, None] for c in ("stop", "take_profit", "trail"))
            with np.errstate(all="ignore"):
                ret = np.where(long, path / start - 1, 1 - path / start)
                best = np.maximum(0.0, np.fmax.accumulate(ret, axis=1))
                peak = np.maximum(start, np.fmax.accumulate(path, axis=1))
                trough = np.minimum(start, np.fmin.accumulate(path, axis=1))
                fall = np.where(long, (peak - path) / peak, (path - trough) / trough)
                trailing = (best > take * activation) & (fall >= trail * np.where(best >= 1.5 * take, tight, normal))
                last = np.broadcast_to(np.arange(hold) == hold - 1, ret.shape) & ~np.isnan(path)
                hits = np.stack([ret <= -stop, trailing, ret >= take, last]) & ~np.isnan(path)
            met = hits.any(axis=0)
            first = met.argmax(axis=1)
            found = np.flatnonzero(met.any(axis=1))
            reason = hits[:, found, first[found]].argmax(axis=0)
            k = e["n"].to_numpy()[found]
            if len(found):
                out.append([np.asarray(c, object) for c in (e["symbol"].iloc[found], k, e["side"].iloc[found], k + first[found] + 1, [order[r] for r in reason], ret[found, first[found]])])
                went = path[found], ret[found]
                until = np.arange(hold)[None, :] <= first[found][:, None]
                seen = [np.where(until, x, np.nan) for x in went]
                out[-1] += [np.asarray(c, object) for c in (start[found, 0], path[found, first[found]], np.nanmax(seen[1], axis=1), np.nanmin(seen[1], axis=1), np.nanmin(seen[0], axis=1), np.nanmax(seen[0], axis=1))]
        names = [c.split()[0] for c in JOURNAL.split(", ")]
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))) if out else {c: np.empty(0, object) for c in names}, dtype=object)

    return spread(marks, lookahead=hold, tile_rows=tile_rows).groupBy("symbol", "tile").applyInPandas(run, JOURNAL)


def kill_switch(curve: DataFrame, most_fall: float, keys=SYMBOL, order=("ts", "order_id", "line", "pnl")) -> DataFrame:
    """``halted``: whether a drawdown of ``most_fall`` was reached on this row or before; it stays so."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("halted", F.max(F.col("dd") <= -most_fall).over(w))


def regime_changes(df: DataFrame, regime: str = "regime_id", keys=SYMBOL) -> DataFrame:
    """``changed`` and ``age``: whether the regime differs from the row before, and rows since it last did."""
    w = ordered(keys)
    df = df.withColumn("changed", F.coalesce(F.col(regime) != F.lag(regime).over(w), F.lit(True))).withColumn("__n", F.row_number().over(w))
    start = F.last(F.when(F.col("changed"), F.col("__n")), ignorenulls=True).over(so_far(keys))
    return df.withColumn("age", F.col("__n") - start).drop("__n")


def dwell_times(df: DataFrame, regime: str = "regime_id", keys=SYMBOL) -> DataFrame:
    """(regime, visits, mean_s): visits of each regime and their mean length in seconds; the last visit is still open."""
    starts = regime_changes(df, regime, keys).where("changed")
    seconds = F.unix_micros(F.lead("ts").over(ordered(keys)).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return starts.withColumn("s", seconds / 1e6).groupBy(F.col(regime).alias("regime")).agg(F.count("*").alias("visits"), F.avg("s").alias("mean_s"))


def signal_weights(signals: DataFrame, names: tuple[str, ...], outcome: str = "ret", n: int = 100, least: float = 0.05, keys=SYMBOL) -> DataFrame:
    """Weights of signals by their accuracy over the last n rows, and the composite ``direction, strength, actionable``.

    A signal of the row before is right if it has the sign of this row's outcome, or is 0 itself. Weights are accuracy
    above 0.3, at least ``least``, brought to a sum of 1; without any outcome they are equal.
    """
    w = ordered(keys)
    window = w.rowsBetween(1 - n, 0)
    for s in names:
        was = F.lag(s).over(w)
        right = ((was > 0) & (F.col(outcome) > 0)) | ((was < 0) & (F.col(outcome) < 0)) | (F.abs(was) < 1e-8)
        signals = signals.withColumn(f"__right_{s}", F.when(was.isNotNull() & F.col(outcome).isNotNull(), F.when(right, 1.0).otherwise(0.0)))
    raw = {s: F.greatest(F.lit(least), F.coalesce(F.avg(f"__right_{s}").over(window), F.lit(0.3 + least)) - 0.3) for s in names}
    signals = signals.withColumns({f"__raw_{s}": raw[s] for s in names})
    total = sum((F.col(f"__raw_{s}") for s in names), F.lit(0.0))
    signals = signals.withColumns({f"w_{s}": F.col(f"__raw_{s}") / total for s in names})
    direction = sum((F.col(f"w_{s}") * F.col(s) for s in names), F.lit(0.0))
    signals = signals.withColumn("direction", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), direction)))
    out = signals.withColumn("strength", F.abs("direction")).withColumn("actionable", F.col("strength") >= 0.15)
    return out.drop(*(f"__right_{s}" for s in names), *(f"__raw_{s}" for s in names))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...], least: int = 10) -> DataFrame:
    """Rank correlation with mean ranks for ties, by group; 0 with fewer than ``least`` rows. Ranks come from ranges, so a group is many tasks."""
    found = rank_correlation(df, x, y, by)
    return found.select(*by, "n", F.when(F.col("n") < least, 0.0).otherwise(F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0))).alias("ic"))


def hit_rate(df: DataFrame, prediction: str, outcome: str, by: tuple[str, ...], dead: float = 0.01, least: int = 5) -> DataFrame:
    """Share of predictions outside the dead zone that have the outcome's sign; 0.5 with fewer than ``least``."""
    used = F.abs(prediction) >= dead
    hit = F.when(used, F.when(F.signum(prediction) == F.signum(outcome), 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(F.sum(F.when(used, 1).otherwise(0)).alias("n"), F.when(F.sum(F.when(used, 1).otherwise(0)) < least, 0.5).otherwise(F.avg(hit)).alias("hit_rate"))
