"""Joins, aggregations and reports over fills, trades and orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from .carried import last_known
from .quantiles import exact_quantiles
from .tiles import spread, tiled


def signed_quantity():
    """Bought quantity, or minus the sold one."""
    return F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))


def as_of_quotes(trades: DataFrame, quotes: DataFrame, fields=("bid", "ask"), tile_rows: int = 10_000) -> DataFrame:
    """Each trade with the newest value of every quote field at or before it, field by field; null if never quoted.

    One union whose fields are carried from tile to tile, no range join; a quote at a trade's own instant counts if its
    seq is not larger.
    """
    both = trades.select("symbol", "seq", "ts", F.lit(True).alias("is_trade"), *(F.lit(None).cast("double").alias(f) for f in fields)).unionByName(
        quotes.select("symbol", "seq", "ts", F.lit(False).alias("is_trade"), *fields)
    )
    return last_known(tiled(both, tile_rows), {f: F.col(f) for f in fields}).where("is_trade").drop("is_trade", "n", "tile")


def orphaned_orders(submitted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Submitted orders without any row in ``resolved``."""
    return submitted.join(resolved.select("order_id").distinct(), "order_id", "left_anti")


def net_positions(fills: DataFrame, least: float = 1e-10) -> DataFrame:
    """Signed quantity by symbol, but for flat ones."""
    return fills.groupBy("symbol").agg(F.sum(signed_quantity()).alias("position")).where(F.abs("position") > least)


def reconciled(ledger: DataFrame, broker: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Positions of both sides, the broker's where they differ: (symbol, ledger, broker, position, differs)."""
    both = ledger.select("symbol", F.col("position").alias("ledger")).join(broker.select("symbol", F.col("position").alias("broker")), "symbol", "full")
    gap = F.abs(F.coalesce("ledger", F.lit(0.0)) - F.coalesce("broker", F.lit(0.0)))
    return both.select("symbol", "ledger", "broker", F.coalesce("broker", "ledger").alias("position"), (gap > tolerance).alias("differs"))


def attribution(trades: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Profit by each dimension on its own, in one pass: (dim, value, total, n, win_rate, mean, share)."""
    named = trades.select("pnl", *(F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dims))
    sums = [F.sum("pnl").alias("total"), F.count("*").alias("n"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("pnl").alias("mean")]
    out = named.groupingSets([[F.col(d)] for d in dims], *(F.col(d) for d in dims)).agg(*sums, *(F.grouping(d).alias(f"__{d}") for d in dims))
    dim = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims))
    value = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.col(d)) for d in dims))
    out = out.select(dim.alias("dim"), value.alias("value"), "total", "n", "win_rate", "mean")
    whole = F.sum("total").over(Window.partitionBy("dim"))
    return out.withColumn("share", F.when(whole == 0, 1.0).otherwise(F.col("total") / whole))


def holding_bins(trades: DataFrame, edges=(0, 5, 10, 20, 50, 100, 1000)) -> DataFrame:
    """Trades by holding time in half-open bins; empty bins and times from the last edge on are left out."""
    label = None
    for low, high in zip(edges, edges[1:]):
        hit = (F.col("hold") >= low) & (F.col("hold") < high)
        label = F.when(hit, f"{low}-{high}") if label is None else label.when(hit, f"{low}-{high}")
    binned = trades.withColumn("bin", label).where("bin IS NOT NULL")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("pnl").alias("total"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def exposure(positions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Long, short, gross, net and gross over net of position values of 0.01 or more."""
    value = F.col("position") * F.col("mark")
    kept = positions.withColumn("value", value).where(F.abs("value") >= 0.01)
    long, short = F.sum(F.when(F.col("value") > 0, F.col("value")).otherwise(0.0)), F.sum(F.when(F.col("value") < 0, -F.col("value")).otherwise(0.0))
    return kept.groupBy(*by).agg(long.alias("long"), short.alias("short"), F.sum(F.abs("value")).alias("gross"), F.sum("value").alias("net"))


def slippage(fills: DataFrame) -> DataFrame:
    """``slippage_bps`` (positive is worse than arrival), ``shortfall`` in money and ``hour`` of the fill."""
    worse = F.when(F.col("side") == "BUY", F.col("price") - F.col("arrival_price")).otherwise(F.col("arrival_price") - F.col("price"))
    bps = F.when(F.col("arrival_price") > 0, worse / F.col("arrival_price") * 10_000).otherwise(0.0)
    return fills.withColumns({"slippage_bps": bps, "shortfall": worse * F.col("qty"), "hour": F.hour("ts")})


def execution_report(fills: DataFrame, dims: tuple[str, ...] = ("side", "regime_id", "order_type"), held: int = 1_000_000) -> DataFrame:
    """Slippage statistics over all fills and by each dimension: one pass of grouping sets; beyond ``held`` fills the percentiles are narrowed down."""
    base = slippage(fills).select("slippage_bps", "shortfall", "fees", *(F.col(d).cast("string").alias(d) for d in dims))
    sets = [[], *([F.col(d)] for d in dims)]
    shares = {"median_bps": 0.5, "p95_bps": 0.95}
    few = base.count() <= held
    out = base.groupingSets(sets, *(F.col(d) for d in dims)).agg(
        F.count("*").alias("n"),
        F.avg("slippage_bps").alias("mean_bps"),
        *(F.percentile("slippage_bps", F.lit(s)).alias(c) for c, s in shares.items() if few),
        F.max("slippage_bps").alias("max_bps"),
        F.sum("shortfall").alias("shortfall"),
        F.sum("fees").alias("fees"),
        *(F.grouping(d).alias(f"__{d}") for d in dims),
    )
    dim = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.col(d)) for d in dims), F.when(sum(F.col(f"__{d}") for d in dims) == len(dims), F.lit("all")))
    out = out.withColumns({"dim": dim, "value": value})
    if not few:
        each = F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims))
        long = base.select("slippage_bps", F.inline(each))
        found = exact_quantiles(long, "slippage_bps", tuple(shares.values()), ("dim", "value"), held, tuple(shares)).drop("n")
        out = out.join(found.withColumnsRenamed({"dim": "__dim", "value": "__value"}), (F.col("dim") == F.col("__dim")) & F.col("value").eqNullSafe(F.col("__value")))
    return out.select("dim", "value", "n", "mean_bps", "median_bps", "p95_bps", "max_bps", "shortfall", "fees")


def cost_curve(fills: DataFrame, grid=(0.0, 0.5, 1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """Cost of all notional at each of a grid of basis points, beside the fees paid."""
    sums = fills.agg(F.sum(F.col("qty") * F.col("price")).alias("notional"), F.sum("fees").alias("actual"))
    return sums.select(F.explode(F.array(*(F.lit(g) for g in grid))).alias("bps"), "notional", "actual").withColumn("cost", F.col("notional") * F.col("bps") / 10_000)


def round_trips(fills: DataFrame) -> DataFrame:
    """Closed positions of each symbol: (symbol, trip, opened, closed, side, qty, pnl, fees).

    A trip opens when a flat position is left and closes when it is flat again or changes sign; a fill that flips the
    position is split into the part that closes and the part that opens. Trips are numbered by the zero and sign
    crossings of the running position, so no row needs the state of another but through sums.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "order_id", "line")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    f = fills.withColumn("signed", signed_quantity()).withColumn("after", F.sum("signed").over(running)).withColumn("before", F.col("after") - F.col("signed"))
    flips = F.col("before") * F.col("after") < 0
    parts = F.when(flips, F.array(F.struct((-F.col("before")).alias("q"), F.lit(0).alias("p")), F.struct(F.col("after").alias("q"), F.lit(1).alias("p")))).otherwise(
        F.array(F.struct(F.col("signed").alias("q"), F.lit(0).alias("p")))
    )
    split = f.select("symbol", "ts", "order_id", "line", "price", "fees", "signed", F.inline(parts))
    w = Window.partitionBy("symbol").orderBy("ts", "order_id", "line", "p")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    split = split.withColumn("after", F.sum("q").over(running))
    closes = F.abs("after") < 1e-9
    split = split.withColumn("trip", F.coalesce(F.sum(F.when(closes, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = F.when(F.col("signed") != 0, F.abs(F.col("q") / F.col("signed"))).otherwise(0.0)
    trips = split.groupBy("symbol", "trip").agg(
        F.min("ts").alias("opened"),
        F.max("ts").alias("closed"),
        F.min_by("q", F.struct("ts", "order_id", "line", "p")).alias("first"),
        F.sum(F.abs("q")).alias("traded"),
        F.sum(-F.col("q") * F.col("price")).alias("gross"),
        F.sum(F.col("fees") * share).alias("fees"),
        F.abs(F.sum("q")).alias("left"),
    )
    return trips.where("left < 1e-9").select(
        "symbol", "trip", "opened", "closed", F.when(F.col("first") > 0, "LONG").otherwise("SHORT").alias("side"), (F.col("traded") / 2).alias("qty"), (F.col("gross") - F.col("fees")).alias("pnl"), "fees"
    )


def forward_curves(marks: DataFrame, horizon: int = 50, tile_rows: int = 10_000) -> DataFrame:
    """Mean absolute log return from each regime transition to each of the next ``horizon`` rows: (from_regime, to_regime, offset, n, curve).

    ``marks(symbol, ts, seq, price, regime_id)``; a transition is a row whose regime differs from the row before, and
    counts if all its horizon rows exist. Each tile adds up its own transitions, so no event is multiplied by its horizon.
    """
    ship_package(marks.sparkSession)
    schema = "from_regime long, to_regime long, offset int, n long, total double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable").reset_index(drop=True)
        price, regime = np.log(rows["price"].to_numpy(float)), rows["regime_id"].to_numpy(np.int64)
        changed = np.flatnonzero((regime[1:] != regime[:-1]) & ((rows["tile"] == rows["own"]).to_numpy()[1:])) + 1
        changed = changed[changed + horizon < len(price)]
        out = []
        for a, b in {(regime[i - 1], regime[i]) for i in changed.tolist()}:
            at = changed[(regime[changed - 1] == a) & (regime[changed] == b)]
            totals = [float(np.abs(price[at + d] - price[at]).sum()) for d in range(1, horizon + 1)]
            out.append(pd.DataFrame({"from_regime": a, "to_regime": b, "offset": np.arange(1, horizon + 1), "n": len(at), "total": totals}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    parts = spread(marks, lookback=1, lookahead=horizon, tile_rows=tile_rows).groupBy("symbol", "tile").applyInPandas(run, schema)
    return parts.groupBy("from_regime", "to_regime", "offset").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("curve"))


def half_life(curve: DataFrame, by: tuple[str, ...] = ("from_regime", "to_regime"), least: int = 5) -> DataFrame:
    """Log-linear fit of each decaying curve from its peak on: (by, slope, half_life, r2); null half life without decay.

    Curves of fewer than ``least`` events are left out.
    """
    peak = curve.where(F.col("n") >= least).groupBy(*by).agg(F.max_by("offset", F.struct("curve", -F.col("offset"))).alias("peak"))
    tail = curve.join(peak, list(by)).where("offset >= peak AND curve > 0")
    x, y = F.col("offset") - F.col("peak"), F.log("curve")
    fit = tail.groupBy(*by).agg(F.regr_slope(y, x.cast("double")).alias("slope"), F.regr_r2(y, x.cast("double")).alias("r2"))
    return fit.select(*by, "slope", F.when(F.col("slope") < 0, F.log(F.lit(2.0)) / -F.col("slope")).alias("half_life"), "r2")


def correlations(returns: DataFrame, block_symbols: int = 256, chunk_rows: int = 200_000) -> DataFrame:
    """Pearson correlation of every pair of symbols over the slots both have: (a, b, n, rho). ``returns(symbol, slot, ret)``, a row per symbol and slot.

    Slots are dealt into chunks of about ``chunk_rows`` rows and symbols into blocks; a task multiplies the matrices of
    two blocks in one chunk and sends on sums for each pair, so what is shuffled does not grow with pairs times slots.
    """
    ship_package(returns.sparkSession)
    means = returns.where(F.col("ret").isNotNull()).groupBy("symbol").agg(F.count("*").alias("__n"), F.avg("ret").alias("__mean"))
    means = materialize(means, "symbol-means")
    size = means.agg(F.count("*").alias("symbols"), F.sum("__n").alias("rows")).first()
    blocks, chunks = max(1, -(-size["symbols"] // block_symbols)), max(1, -(-(size["rows"] or 0) // chunk_rows))
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    d = returns.where(F.col("ret").isNotNull()).join(means, "symbol").select("symbol", "slot", (F.col("ret") - F.col("__mean")).alias("x"), own.alias("own"), F.pmod(F.xxhash64(F.lit(5), "slot"), F.lit(chunks)).cast("int").alias("chunk"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    d = d.withColumn("other", other).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    kind = returns.schema["symbol"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(rows["symbol"].unique())
        slots, at = np.unique(rows["slot"].to_numpy(), return_inverse=True)
        column = rows["symbol"].map({s: i for i, s in enumerate(names)}).to_numpy()
        x, has = np.zeros((len(slots), len(names))), np.zeros((len(slots), len(names)))
        x[at, column], has[at, column] = rows["x"].to_numpy(float), 1.0
        i, j = np.triu_indices(len(names), 1)
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        if low != high:  # pairs within a block belong to its own task
            block = dict(zip(rows["symbol"], rows["own"]))
            block = np.array([block[s] for s in names])
            apart = block[i] != block[j]
            i, j = i[apart], j[apart]
        parts = {"n": has.T @ has, "sx": x.T @ has, "sxx": (x * x).T @ has, "sxy": x.T @ x}
        met = parts["n"][i, j] > 0
        i, j = i[met], j[met]
        named = {c: pd.Series([names[k] for k in at], dtype=object) for c, at in (("a", i), ("b", j))}
        return pd.DataFrame({**named, "n": parts["n"][i, j], "sx": parts["sx"][i, j], "sy": parts["sx"].T[i, j], "sxx": parts["sxx"][i, j], "syy": parts["sxx"].T[i, j], "sxy": parts["sxy"][i, j]})

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = d.groupBy("chunk", "low", "high").applyInPandas(run, f"a {kind}, b {kind}, " + ", ".join(f"{c} double" for c in sums))
    g = parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in sums))
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    rho = F.when((n > 1) & (vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    return g.select("a", "b", n.cast("long").alias("n"), rho.alias("rho"))
