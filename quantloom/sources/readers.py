"""Tick sources: delimited and columnar files, vendor book exports, a seeded generator, and a stream of files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship_package

TICK = "symbol string, seq long, ts timestamp_ntz, price double, volume double, bid double, ask double, bid_size double, ask_size double, exchange string"
CSV = "timestamp string, symbol string, price double, volume double, bid double, ask double, bid_size double, ask_size double, exchange string"


def _finite(col):
    return F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))


def csv_ticks(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Ticks of delimited files with a header; columns other than timestamp and price may be missing.

    Rows without a finite price above 0 or a readable timestamp are dropped; volumes that are no finite number become
    0, the exchange defaults to generic. ``seq`` is a hash of the row, so that equal timestamps have the same order
    however the files are split; rows equal in all have one seq.
    """
    raw = spark.read.csv(path, header=True)
    fields = {name.split()[0]: name.split()[1] for name in CSV.split(", ")}
    cols = {c: (F.expr(f"try_cast({c} AS {kind})") if c in raw.columns else F.lit(None).cast(kind)) for c, kind in fields.items()}
    d = raw.select(*(v.alias(c) for c, v in cols.items())).withColumn("ts", F.expr("try_cast(timestamp AS timestamp_ntz)"))
    d = d.where(_finite("price") & (F.col("price") > 0) & F.col("ts").isNotNull())
    d = d.withColumns({"volume": F.when(_finite("volume"), F.col("volume")).otherwise(0.0), "exchange": F.coalesce("exchange", F.lit("generic")), "symbol": F.coalesce(F.lit(symbol), F.col("symbol"), F.lit("UNKNOWN"))})
    row = F.xxhash64(*(c for c in d.columns if c != "timestamp"))
    return d.withColumn("seq", F.pmod(row, F.lit(1 << 62))).select(*(f.split()[0] for f in TICK.split(", ")))


def stored_ticks(spark: SparkSession, path: str, symbol: str | None = None, start=None, end=None) -> DataFrame:
    """Stored ticks with an equality and an inclusive range that reach the scan; not-a-number becomes null."""
    d = spark.read.parquet(path)
    for condition in ([F.col("symbol") == symbol] if symbol else []) + ([F.col("ts") >= F.lit(start)] if start else []) + ([F.col("ts") <= F.lit(end)] if end else []):
        d = d.where(condition)
    return d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("bid", "ask", "bid_size", "ask_size") if c in d.columns})


def book_export(rows: DataFrame, trades_only: bool = False) -> DataFrame:
    """Ticks of a vendor's ten-level book export: prices in units of 1e-9, levels as arrays of (px, sz).

    Trades (action T) always come, best-level updates as ticks of volume 0 unless ``trades_only``. Levels without a
    valid price and size go; a side that a snapshot leaves empty keeps its last levels.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = rows
    for side in ("bids", "asks"):
        valid = F.filter(F.transform(side, lambda x: F.struct((x["px"] * 1e-9).alias("price"), x["sz"].cast("double").alias("size"))), lambda x: (x["price"] > 0) & (x["price"] < 1e9) & (x["size"] > 0))
        d = d.withColumn(side, valid).withColumn(side, F.last(F.when(F.size(side) > 0, F.col(side)), ignorenulls=True).over(w))
    trade = F.col("action") == "T"
    kept = d.where(trade | F.lit(not trades_only) & (F.col("depth") == 0))
    bid, ask = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    mid = (bid["price"] + ask["price"]) / 2
    return kept.select(
        "symbol", "seq", "ts", F.when(trade, F.col("price") * 1e-9).otherwise(mid).alias("price"), F.when(trade, F.col("size").cast("double")).otherwise(0.0).alias("volume"),
        bid["price"].alias("bid"), ask["price"].alias("ask"), bid["size"].alias("bid_size"), ask["size"].alias("ask_size"), "bids", "asks",
    )


def scaled_export(rows: DataFrame) -> DataFrame:
    """Ticks of a vendor's export whose prices may be in units of 1e-9: magnitudes above a million are; a missing price is the mid."""
    cols = ("price", "bid", "ask")
    scaled = rows.withColumns({c: F.when(F.abs(c) > 1e6, F.col(c) * 1e-9).otherwise(F.col(c).cast("double")) for c in cols})
    return scaled.withColumn("price", F.coalesce("price", (F.col("bid") + F.col("ask")) / 2))


def log_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of delimited logs with a header (decisions, journal, market states); malformed rows are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path, header=True)


def restored_state(spark: SparkSession, path: str, now, most_age_s: float = 300.0, key: str = "symbol") -> DataFrame:
    """The newest saved state of each key that is not older than ``most_age_s`` seconds at ``now``; none is better than a stale one."""
    d = spark.read.parquet(path)
    newest = d.groupBy(key).agg(F.max_by(F.struct(*(c for c in d.columns if c != key)), "saved_at").alias("state")).select(key, "state.*")
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("saved_at").cast("timestamp"))
    return newest.where(age <= most_age_s * 1e6)


def synthetic_ticks(spark: SparkSession, symbols: int, rows: int, seed: int = 42, drift: float = 0.0, tick: float = 0.25, start: str = "2024-01-01") -> DataFrame:
    """A random walk from 10000 for each symbol, generated by a task of its own from (seed, symbol).

    Gaps of 10 to 999 ms, normal steps, prices on the tick grid and not below one tick, quotes a tick away on each side.
    """
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for i in batch["id"].tolist():
                r = np.random.default_rng([seed, i])
                ms = np.cumsum(r.integers(10, 1000, rows))
                price = np.maximum(np.round((10_000 + np.cumsum(r.normal(drift, tick, rows))) / tick) * tick, tick)
                yield pd.DataFrame(
                    {
                        "symbol": f"S{i}", "seq": np.arange(rows), "ts": pd.Timestamp(start) + pd.to_timedelta(ms, unit="ms"), "price": price, "volume": np.abs(r.normal(1, 0.5, rows)),
                        "bid": price - tick, "ask": price + tick, "bid_size": np.abs(r.normal(5, 2, rows)), "ask_size": np.abs(r.normal(5, 2, rows)), "exchange": "generic",
                    }
                )

    return spark.range(0, symbols, 1, symbols).mapInPandas(run, TICK)


def stream_ticks(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of stored tick files in the same schema."""
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tick_source(spark: SparkSession, config: dict) -> DataFrame:
    """The source that a configuration names: stored, csv, or else synthetic."""
    kind = config.get("kind")
    if kind == "stored":
        return stored_ticks(spark, config["path"], config.get("symbol"), config.get("start"), config.get("end"))
    if kind == "csv":
        return csv_ticks(spark, config["path"], config.get("symbol"))
    return synthetic_ticks(spark, config.get("symbols", 1), config.get("rows", 1000), config.get("seed", 42))
