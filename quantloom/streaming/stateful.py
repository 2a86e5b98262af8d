"""Keyed state with event-time timers: rows are worked on in their own order, state expires, is read back and is restored."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..cluster import ship_package

ROWS = "at timestamp, seq long, price double, volume double"
TOTALS = "bucket long, volume double, buy double, price double, at timestamp"
OUT = "symbol string, bucket long, imbalance double"

#: The state store that timers need; set it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class VolumeBucketProcessor(StatefulProcessor):
    """Closes a volume bucket of a symbol once its ticks, in order of time and number, come to ``size``.

    Ticks are held until the watermark has passed them, so those of later triggers that are older come first, as in a
    batch. With ``idle_ms``, the totals of a symbol without ticks for that long are forgotten.
    """

    def __init__(self, size: float, idle_ms: int | None):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ROWS)
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.totals.update((int(row["bucket"]), float(row["volume"]), float(row["buy"]), float(row["price"]), row["at"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.held.appendList([(a, int(s), float(p), float(v)) for a, s, p, v in zip(part["at"], part["seq"], part["price"], part["volume"])])
            self.handle.registerTimer(_ms(part["at"].min()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.held.get(), key=lambda r: (r[0], r[1])) if self.held.exists() else []
        ready = [r for r in rows if _ms(r[0]) < passed]
        rest = rows[len(ready) :]
        bucket, volume, buy, price, at = self.totals.get() if self.totals.exists() else (0, 0.0, 0.0, float("nan"), None)
        out = []
        for at, _, p, v in ready:
            volume, buy, price = volume + v, buy + (v if p >= price else 0.0), p
            if volume >= self.size:
                out.append((key[0], bucket, abs(2 * buy - volume) / max(volume, 1e-10)))
                bucket, volume, buy, price = bucket + 1, 0.0, 0.0, float("nan")
        if ready:
            self.totals.update((bucket, volume, buy, price, at))
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        if rest:
            self.handle.registerTimer(_ms(rest[0][0]) + 1)
        elif self.idle_ms is not None and at is not None:
            if _ms(at) + self.idle_ms < passed:
                self.totals.clear()
            else:
                self.handle.registerTimer(_ms(at) + self.idle_ms + 1)
        return iter((pd.DataFrame(out, columns=["symbol", "bucket", "imbalance"]),) if out else ())

    def close(self) -> None:
        pass


def _ms(at) -> int:
    """Milliseconds of an instant, rounded up: a watermark beyond them has passed it."""
    at = pd.Timestamp(at)
    return int(-(-(at.tz_localize("UTC") if at.tzinfo is None else at).value // 1_000_000))


def ordered_volume_buckets(ticks: DataFrame, size: float = 500.0, late: str = "30 seconds", idle_s: float | None = None, restored: DataFrame | None = None) -> DataFrame:
    """Closed volume buckets (symbol, bucket, imbalance) of a stream, equal to those of the batch whatever its triggers.

    Ticks may come out of order up to ``late``; later ones are dropped. A bucket comes out once the watermark has
    passed its last tick. ``restored(symbol, bucket, volume, buy, price, at)`` is what symbols start from on a fresh
    checkpoint, see ``saved_totals`` and ``readers.restored_state``. The session needs ``STATE_STORE``.
    """
    ship_package(ticks.sparkSession)
    d = ticks.select("symbol", F.col("ts").cast("timestamp").alias("at"), "seq", "price", "volume").withWatermark("at", late)
    initial = restored.select("symbol", "bucket", "volume", "buy", "price", "at").groupBy("symbol") if restored is not None else None
    idle_ms = None if idle_s is None else int(idle_s * 1000)
    return d.groupBy("symbol").transformWithStateInPandas(VolumeBucketProcessor(size, idle_ms), OUT, "append", "eventTime", initial)


def saved_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The totals that a stopped stream left in its checkpoint: (symbol, bucket, volume, buy, price, at, saved_at), ``saved_at`` being the last tick's time."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "totals").load()
    return state.select(F.col("key.symbol").alias("symbol"), *(F.col(f"value.{c}").alias(c) for c in ("bucket", "volume", "buy", "price", "at"))).withColumn("saved_at", F.col("at"))
