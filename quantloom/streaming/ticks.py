"""The same features over a stream: watermarked windows, and keyed state for what windows cannot carry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship_package

LATE = "30 seconds"


def time_bars(ticks: DataFrame, width: str = "60 seconds", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Open, high, low, close, volume and count by time window; ticks later than the watermark are dropped."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    seen = F.struct("at", "seq")
    bars = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy("symbol", window).agg(
        F.min_by("price", seen).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seen).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    return bars.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def gap_alerts(ticks: DataFrame, quiet: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Sessions of activity that a pause ends: (symbol, opened, closed, n)."""
    s = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy("symbol", F.session_window("at", quiet)).agg(F.count("*").alias("n"))
    return s.select("symbol", F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n")


def stream_volume_buckets(ticks: DataFrame, size: float = 500.0) -> DataFrame:
    """Closed volume buckets (symbol, bucket, imbalance) from a stream: the batch recurrence on keyed state."""
    ship_package(ticks.sparkSession)

    def run(key, batches, state: GroupState):
        bucket, volume, buy, price = state.get if state.exists else (0, 0.0, 0.0, float("nan"))
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for p, v in zip(rows["price"].tolist(), rows["volume"].tolist()):
            volume, buy, price = volume + v, buy + (v if p >= price else 0.0), p
            if volume >= size:
                out.append((key[0], bucket, abs(2 * buy - volume) / max(volume, 1e-10)))
                bucket, volume, buy, price = bucket + 1, 0.0, 0.0, float("nan")
        state.update((bucket, volume, buy, price))
        yield pd.DataFrame(out, columns=["symbol", "bucket", "imbalance"])

    return ticks.groupBy("symbol").applyInPandasWithState(
        run, "symbol string, bucket long, imbalance double", "bucket long, volume double, buy double, price double", "append", GroupStateTimeout.NoTimeout
    )


def stream_gate(ticks: DataFrame) -> DataFrame:
    """Rows whose own quotes and price are sound: the stateless part of the quality gate."""
    return ticks.where((F.col("price") > 0) & ~F.coalesce(F.col("bid") > F.col("ask"), F.lit(False)))
