"""Boosted trees refitted block by block, each on the rows before it, and used as long as no better fit is accepted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism, materialize, ship_package
from ..functions.normal import cumulative
from .carried import exponential_means
from .tiles import numbered, rolling
from .windows import sliding_sums

BINS = 32
FITTED = "block long, rows long, val_mse double, val_var double, accepted boolean, base double, columns array<int>, cuts array<double>, values array<double>"


def grown(binned: np.ndarray, gradient: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One regression tree for each sample as (column, bin, leaf value): node k has children 2k+1 and 2k+2, and splits by bin <= its own; -1 is no split.

    ``binned`` has samples of as many rows, ``gradient`` a value for each row; the histograms of a level are made for all samples, columns and nodes at once.
    """
    samples, count, width = binned.shape
    column, cut = np.full((samples, 2**depth - 1), -1, np.int64), np.zeros((samples, 2**depth - 1), np.int64)
    at, each = np.zeros((samples, count), np.int64), np.arange(samples)[:, None]  # node within the level
    turned, weights = np.ascontiguousarray(binned.transpose(0, 2, 1)), np.repeat(gradient, width, axis=0).ravel()
    place = (np.arange(samples * width) * BINS).reshape(samples, width, 1)
    for level in range(depth):
        nodes = 2**level
        key = (turned + place * nodes + (at * BINS)[:, None, :]).ravel()
        shape = (samples, width, nodes, BINS)
        n = np.bincount(key, minlength=samples * width * nodes * BINS).reshape(shape).cumsum(axis=3)
        s = np.bincount(key, weights, samples * width * nodes * BINS).reshape(shape).cumsum(axis=3)
        whole_n, whole_s = n[..., -1:], s[..., -1:]
        right = whole_n - n
        fits = (n >= least) & (right >= least)
        gain = np.where(fits, s**2 / np.maximum(n, 1) + (whole_s - s) ** 2 / np.maximum(right, 1) - whole_s**2 / np.maximum(whole_n, 1), -1.0)
        where, top = gain.argmax(axis=3), gain.max(axis=3)
        best, own = top.argmax(axis=1), np.arange(nodes)  # the first column, where several gain as much
        split = top[each, best, own] > 1e-12
        column[:, nodes - 1 : 2 * nodes - 1] = np.where(split, best, -1)
        cut[:, nodes - 1 : 2 * nodes - 1] = np.where(split, where[each, best, own], 0)
        at = descend(binned, column, cut, at, nodes - 1)
    leaf = (at + each * 2**depth).ravel()
    sums, sizes = np.bincount(leaf, gradient.ravel(), samples * 2**depth), np.bincount(leaf, minlength=samples * 2**depth)
    return column, cut, (sums / np.maximum(sizes, 1)).reshape(samples, -1)


def grow(binned: np.ndarray, gradient: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grown`` of one sample."""
    return tuple(p[0] for p in grown(binned[None], gradient[None], depth, least))


def descend(binned: np.ndarray, column: np.ndarray, cut: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """The places in the next level of the rows that are ``at`` places of the level whose first node is ``first``."""
    samples, count, width = binned.shape
    node = at + (np.arange(samples) * column.shape[1] + first)[:, None]
    own = column.ravel()[node]
    value = binned.ravel()[np.arange(samples * count).reshape(samples, count) * width + np.maximum(own, 0)]
    return 2 * at + ((own >= 0) & (value > cut.ravel()[node]))


def boosts(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, share: float, least: int, seed: int) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """(base, columns, cuts, values) for each sample (x[i], y[i]): trees on the residuals of those before, each on a drawn share of the rows; cuts are values of x."""
    samples, count, width = x.shape
    binned, real = np.empty(x.shape, np.int64), np.full((samples, width, BINS), np.inf)  # the value of x that a bin ends at
    for i in range(samples):
        for c in range(width):
            edges = np.unique(np.quantile(x[i, :, c], np.arange(1, BINS) / BINS))
            binned[i, :, c], real[i, c, : len(edges)] = np.searchsorted(edges, x[i, :, c], side="left"), edges
    draw, each = np.random.default_rng(seed), np.arange(samples)[:, None]
    base = np.array([float(v.mean()) for v in y])
    out = np.repeat(base[:, None], count, axis=1)
    columns, cuts, values = [], [], []
    for _ in range(rounds):
        rows = draw.random(count) < share
        column, cut, value = grown(binned[:, rows], (y - out)[:, rows], depth, least)
        columns.append(column.astype(np.int32))
        cuts.append(np.where(column >= 0, real[each, np.maximum(column, 0), cut], np.inf))
        values.append(rate * value)
        at = np.zeros(y.shape, np.int64)
        for level in range(depth):  # a bin is above a cut where its values are
            at = descend(binned, column, cut, at, 2**level - 1)
        out += values[-1][each, at]
    columns, cuts, values = (np.concatenate(p, axis=1) for p in (columns, cuts, values))
    return [(float(base[i]), columns[i], cuts[i], values[i]) for i in range(samples)]


def boost(x: np.ndarray, y: np.ndarray, *how) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """``boosts`` of one sample."""
    return boosts(x[None], y[None], *how)[0]


def predict_tree(x: np.ndarray, column: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while len(at) and at[0] < len(column):
        own = column[at]
        at = 2 * at + 1 + ((own >= 0) & (x[np.arange(len(x)), np.maximum(own, 0)] > cut[at]))
    return value[at - len(column)]


def predict(x: np.ndarray, base: float, columns: np.ndarray, cuts: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    nodes, leaves = 2**depth - 1, 2**depth
    out = np.full(len(x), base)
    for t in range(len(values) // leaves):
        out += predict_tree(x, columns[t * nodes : (t + 1) * nodes], cuts[t * nodes : (t + 1) * nodes], values[t * leaves : (t + 1) * leaves])
    return out


def fitted_blocks(rows: DataFrame, cols: tuple[str, ...], target: str, block: int = 500, keep: int = 5000, least_rows: int = 200, rounds: int = 100, depth: int = 3, rate: float = 0.05, share: float = 0.8, least: int = 10, seed: int = 42, key: str = "symbol", together: int = 5) -> DataFrame:
    """A fit for each block of a symbol, on the newest ``keep`` rows before it: (key, block, rows, val_mse, val_var, accepted, and the trees).

    ``rows`` have ``n``, the number of a row within its symbol. The first four fifths of those rows are fitted and the
    rest tell whether the fit is accepted: their mean squared error is below their variance. The fits of ``together``
    neighbouring blocks are a group, of a bounded number of rows, whatever its symbol, and grow their trees at the same time.
    """
    ship_package(rows.sparkSession)
    own = F.floor((F.col("n") - 1) / block)
    # the groups of blocks that learn from a row
    ahead = F.sequence(F.floor((own + 1) / together), F.floor(F.floor((F.col("n") - 1 + keep) / block) / together))
    last = rows.groupBy(key).agg(F.max(own).alias("__last"))
    learned = rows.where(F.col(target).isNotNull()).select(key, "n", *cols, target, F.explode(ahead).alias("__group"))
    learned = learned.join(last, key).where(F.col("__group") * together <= F.col("__last") + 1)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {FITTED}"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", kind="stable")
        x, y, n = part[list(cols)].fillna(0.0).to_numpy(float), part[target].to_numpy(float), part["n"].to_numpy()
        name, group, final = part[key].iloc[0], int(part["__group"].iloc[0]), int(part["__last"].iloc[0]) + 1
        found, alike = {}, {}
        for number in range(group * together, min((group + 1) * together - 1, final) + 1):
            a, b = np.searchsorted(n, [number * block - keep, number * block], side="right")
            if b - a >= least_rows:
                alike.setdefault(int(b - a), []).append((number, slice(a, b)))
            elif b > a:
                found[number] = (name, number, int(b - a), None, None, False, None, None, None, None)
        for length, fits in alike.items():
            split = int(length * 0.8)
            made = boosts(np.array([x[s][:split] for _, s in fits]), np.array([y[s][:split] for _, s in fits]), rounds, depth, rate, share, least, seed)
            for (number, s), (base, columns, cuts, values) in zip(fits, made):
                rest = y[s][split:]
                error = float(((predict(x[s][split:], base, columns, cuts, values, depth) - rest) ** 2).mean())
                variance = float(rest.var())
                accepted = variance > 1e-15 and error < variance
                found[number] = (name, number, length, error, variance, accepted, base, columns.tolist(), cuts.tolist(), values.tolist())
        return pd.DataFrame([found[i] for i in sorted(found)], columns=[c.split()[0] for c in schema.split(", ")])

    # dealt by number: a fit takes far longer than its bytes would say
    return learned.repartition(default_parallelism(rows.sparkSession), key, "__group").groupBy(key, "__group").applyInPandas(run, schema)


def boosted_predictions(rows: DataFrame, cols: tuple[str, ...], target: str, order: tuple[str, ...] = ("ts", "seq"), block: int = 500, depth: int = 3, key: str = "symbol", **fitting) -> DataFrame:
    """``rows`` with ``gbt``, the prediction of the newest fit that was accepted before the row's block (0 before the first), ``gbt_block``, whose fit that is, and ``gbt_accepted``, whether the fit of the row's own block was accepted.

    Null features count as 0; rows with a null target are predicted but not learned.
    """
    ship_package(rows.sparkSession)
    d = materialize(numbered(rows, key, order), "boosted-rows")  # read by the fits, the blocks and the predictions
    fits = materialize(fitted_blocks(d, cols, target, block=block, depth=depth, key=key, **fitting), "fits")
    upto = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    model = F.struct("block", "base", "columns", "cuts", "values")
    # every block of the rows, with the newest accepted fit (a row per block of a symbol)
    blocks = d.select(key, F.floor((F.col("n") - 1) / block).alias("block")).distinct()
    used = blocks.join(fits, [key, "block"], "left").withColumn("model", F.last(F.when(F.col("accepted"), model), ignorenulls=True).over(upto))
    used = used.select(key, "block", F.coalesce("accepted", F.lit(False)).alias("accepted"), "model.base", "model.columns", "model.cuts", "model.values", F.col("model.block").alias("fit"))
    used = materialize(used, "used-fits")
    source = d.withColumn("block", F.floor((F.col("n") - 1) / block))
    names = [c for c in source.columns if c not in ("gbt", "gbt_block", "gbt_accepted")]
    source = source.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", gbt double, gbt_block long, gbt_accepted boolean"

    def run(part: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        row = fit.iloc[0] if len(fit) else None
        if row is None or row["values"] is None:
            return part.assign(gbt=0.0, gbt_block=None, gbt_accepted=False)
        x = part[list(cols)].fillna(0.0).to_numpy(float)
        found = predict(x, row["base"], np.asarray(row["columns"]), np.asarray(row["cuts"], float), np.asarray(row["values"], float), depth)
        return part.assign(gbt=found, gbt_block=int(row["fit"]), gbt_accepted=bool(row["accepted"]))

    return source.groupBy(key, "block").cogroup(used.groupBy(key, "block")).applyInPandas(run, schema).drop("n", "block")


def rollbacks(errors: DataFrame, by: tuple[str, ...], half: int = 50, ratio: float = 1.3, level: float = 0.05) -> DataFrame:
    """Which version of a model each block of ``half`` errors leaves in use: (by, block, mean_error, ratio, p, degraded, rolled_back, version).

    ``errors(by, k, error)``: absolute errors, ``k`` numbering a model's from 1. A block is degraded if its mean error
    exceeds ``ratio`` times that of the block before, or if its errors rank above those at ``level`` (one-sided
    rank-sum test, normal approximation). A degraded block is rolled back, unless the block before was: the record
    begins anew after a rollback. A block's weights become the version in use unless it is rolled back; then the last
    good one stays. The last block counts only if it is whole. Nothing but windows over blocks and ranks within pairs of them.
    """
    d = errors.withColumn("block", F.floor((F.col("k") - 1) / half)).where(F.col("error").isNotNull())
    w = Window.partitionBy(*by).orderBy("block")
    blocks = d.groupBy(*by, "block").agg(F.avg("error").alias("mean_error"), F.count("*").alias("n")).where(F.col("n") == half)
    blocks = blocks.withColumn("before", F.lag("mean_error").over(w))
    # each error ranks once among its own block and the one before, and once among its own and the next
    paired = d.select(*by, "error", "block", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("pair"))
    pair, tied = Window.partitionBy(*by, "pair"), Window.partitionBy(*by, "pair", "error")
    ranked = paired.withColumn("__rank", F.rank().over(pair.orderBy("error")) + (F.count("*").over(tied) - 1) / 2).withColumn("__ties", F.count("*").over(tied).cast("double"))
    recent = F.col("block") == F.col("pair")
    sums = ranked.groupBy(*by, "pair").agg(F.count(F.when(recent, 1)).alias("n1"), F.count(F.when(~recent, 1)).alias("n2"), F.sum(F.when(recent, F.col("__rank"))).alias("r1"), F.sum(F.col("__ties") ** 2 - 1).alias("tie"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    product = F.col("n1").cast("double") * F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sigma = F.sqrt(product / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (u - product / 2 - 0.5) / F.when(sigma > 0, sigma)
    tests = sums.where((F.col("n1") == half) & (F.col("n2") == half)).select(*by, F.col("pair").alias("block"), F.coalesce(1 - cumulative(z), F.lit(1.0)).alias("p"))
    out = blocks.join(tests, [*by, "block"], "left").withColumn("ratio", F.when(F.col("before") > 1e-10, F.col("mean_error") / F.col("before")))
    degraded = F.coalesce((F.col("ratio") > ratio) | (F.col("p") < level), F.lit(False))
    out = out.withColumn("degraded", degraded)
    # of degraded blocks in a row, every second is rolled back
    island = F.sum(F.when(F.col("degraded"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__island", island)
    inside = F.row_number().over(Window.partitionBy(*by, "__island", "degraded").orderBy("block"))
    out = out.withColumn("rolled_back", F.col("degraded") & (inside % 2 == 1))
    version = F.last(F.when(~F.col("rolled_back"), F.col("block")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("version", version).select(*by, "block", "mean_error", "ratio", "p", "degraded", "rolled_back", "version")


def blended(rows: DataFrame, models: tuple[str, ...], target: str, least: int = 50, decay: float = 0.98, newest: int = 100, tile_rows: int = 10_000, key: str = "symbol") -> DataFrame:
    """``rows`` with ``blend``, ``disagreement`` and a weight ``w_<model>`` for each of ``models``, columns of predictions of ``target``.

    The weights aimed at are the inverse mean absolute errors of the ``newest`` rows before (1 for a model with fewer than ten),
    those in use an exponential mean of them that starts even. Until ``least`` rows are learned, weights stay even and the blend is
    a plain mean. A row is blended before anything is learned from it.
    """

    def aims(d: DataFrame, keys) -> DataFrame:
        d = d.withColumns({f"__e_{m}": F.abs(F.col(target) - F.col(m)) for m in models})
        sums = {f"__s_{m}": F.col(f"__e_{m}") for m in models} | {f"__c_{m}": F.when(F.col(f"__e_{m}").isNotNull(), 1.0) for m in models}
        return sliding_sums(d, sums, newest, keys, newest=1).drop(*(f"__e_{m}" for m in models))

    d = materialize(rolling(rows, newest + 1, aims, tile_rows, key, keep_tile=True), "blend-rows")  # read twice
    inverse = {m: F.when(F.col(f"__c_{m}") >= 10, 1 / F.greatest(F.col(f"__s_{m}") / F.col(f"__c_{m}"), F.lit(1e-10))).otherwise(1.0) for m in models}
    total = sum(inverse.values(), F.lit(0.0))
    learned = F.col("n") - 1 >= least
    d = exponential_means(d, {f"w_{m}": F.when(learned, inverse[m] / total) for m in models}, decay, 1 / len(models), key)
    weights = sum((F.col(f"w_{m}") for m in models), F.lit(0.0))
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    spread = F.sqrt(sum(((F.col(m) - mean) ** 2 for m in models), F.lit(0.0)) / len(models))
    blend = F.when(learned, sum((F.col(f"w_{m}") * F.col(m) for m in models), F.lit(0.0)) / weights).otherwise(mean)
    return d.withColumns({"blend": blend, "disagreement": spread}).drop("n", "tile", *(f"{p}_{m}" for m in models for p in ("__s", "__c")))
