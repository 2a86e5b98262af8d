"""Tick quality: issues per row as an array, the gate that drops critical rows, gaps and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import default_parallelism
from .carried import last_known
from .tiles import spread
from .windows import SYMBOL, ordered, sliding_moments, sliding_sums


def _issue(when: Column, name: str, severity: str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))


def quality_issues(
    ticks: DataFrame,
    gap_warning_ms: float = 5_000.0,
    gap_critical_ms: float = 30_000.0,
    jump_warning: float = 5.0,
    jump_critical: float = 10.0,
    zero_run: int = 10,
    spike: float = 10.0,
    duplicate_run: int = 10,
    keys=SYMBOL,
    tile_rows: int = 10_000,
) -> DataFrame:
    """``issues``: array of (issue, severity, value) found on each row, in the order of arrival (seq).

    TICK_GAP, BACKWARD_TIMESTAMP, CROSSED_MARKET, PRICE_JUMP (against the deviation of up to 99 returns before, from 20
    prices on), ZERO_VOLUME runs, VOLUME_SPIKE (against the mean of up to 500 volumes before), DUPLICATE_TIMESTAMP
    runs. A row that is dropped later has counted for the rows after it.
    """
    # tiles of rows in the order of arrival; a struct of the keys is never null, and neither is a stretch
    stretch = F.coalesce(F.floor(F.col("seq") / 100_000), F.lit(-(1 << 62)))
    rows = ticks.withColumn("__key", F.struct(*keys))
    rows = spread(rows, lookback=502, tile_rows=tile_rows, key="__key", order=("seq",), stretch=stretch, tasks=default_parallelism(ticks.sparkSession))
    tile = ("__key", "tile")
    w = Window.partitionBy(*tile).orderBy("n")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    d = rows.withColumn("__ms", at - F.lag(at).over(w)).withColumn("__ret", F.log(F.col("price") / F.lag("price").over(w)))
    d = sliding_moments(d, "__ret", 99, tile, newest=1, order=("n",))
    deviation = F.when(F.col("n") > 20, F.sqrt("__m2"))
    d = d.withColumn("__z", F.when(deviation > 1e-10, F.abs("__ret") / deviation)).drop("__n", "__mean", "__m2")
    d = sliding_sums(d, {"__volume": F.col("volume"), "__volumes": F.when(F.col("volume").isNotNull(), 1.0)}, 500, tile, newest=1, order=("n",))
    d = d.withColumn("__mean", F.when(F.col("__volumes") > 0, F.col("__volume") / F.col("__volumes"))).drop("__volume", "__volumes")
    # a run ends at the newest row outside it, which may be any number of tiles back
    d = d.where("tile = own")
    zero, same = F.coalesce(F.col("volume") == 0, F.lit(False)), F.coalesce(F.col("__ms") == 0, F.lit(False))
    d = last_known(d, {"__filled": F.when(~zero, F.col("n")), "__fresh": F.when(~same, F.col("n"))}, "__key")
    d = d.withColumn("__zeros", F.col("n") - F.coalesce("__filled", F.lit(0))).withColumn("__same", F.col("n") - F.coalesce("__fresh", F.lit(0)))
    found = F.array_compact(
        F.array(
            F.coalesce(_issue(F.col("__ms") > gap_critical_ms, "TICK_GAP", "CRITICAL", F.col("__ms")), _issue(F.col("__ms") > gap_warning_ms, "TICK_GAP", "WARNING", F.col("__ms"))),
            _issue(F.col("__ms") < 0, "BACKWARD_TIMESTAMP", "CRITICAL", -F.col("__ms")),
            _issue((F.col("bid") > F.col("ask")) & (F.col("bid") > 0) & (F.col("ask") > 0), "CROSSED_MARKET", "CRITICAL", F.col("bid") - F.col("ask")),
            F.coalesce(_issue(F.col("__z") > jump_critical, "PRICE_JUMP", "CRITICAL", F.col("__z")), _issue(F.col("__z") > jump_warning, "PRICE_JUMP", "WARNING", F.col("__z"))),
            _issue(F.col("__zeros") >= zero_run, "ZERO_VOLUME", "WARNING", F.col("__zeros")),
            _issue((F.col("volume") > 0) & (F.col("__mean") > 0) & (F.col("volume") > F.col("__mean") * spike), "VOLUME_SPIKE", "WARNING", F.col("volume") / F.col("__mean")),
            _issue(F.col("__same") > duplicate_run, "DUPLICATE_TIMESTAMP", "WARNING", F.col("__same")),
        )
    )
    return d.withColumn("issues", found).drop("__key", "tile", "own", "n", "__ms", "__ret", "__z", "__filled", "__zeros", "__mean", "__fresh", "__same")


def quality_gate(checked: DataFrame) -> DataFrame:
    """Rows without a critical issue."""
    return checked.where(~F.exists("issues", lambda i: i["severity"] == "CRITICAL"))


def issue_counts(checked: DataFrame) -> DataFrame:
    """(symbol, issue, severity, n)."""
    return checked.select("symbol", F.explode("issues").alias("i")).groupBy("symbol", "i.issue", "i.severity").agg(F.count("*").alias("n"))


def recent_issues(checked: DataFrame, newest: int = 50, kept: int = 1000) -> DataFrame:
    """The ``newest`` issues of each symbol among its last ``kept``: (symbol, seq, place, issue, severity, value), ``place`` in the row's list."""
    each = checked.select("symbol", "seq", F.posexplode("issues").alias("place", "i")).select("symbol", "seq", "place", "i.issue", "i.severity", "i.value")
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("seq"), F.desc("place")))
    return each.withColumn("__back", back).where(F.col("__back") <= min(newest, kept)).drop("__back")  # Spark cuts each task's rows to as many first


def gaps(ticks: DataFrame, expected_s: float, keys=SYMBOL) -> DataFrame:
    """Pauses longer than 1.1 times the expected interval: (symbol, seq, gap_s)."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return ticks.withColumn("gap_s", at - F.lag(at).over(ordered(keys))).where(F.col("gap_s") > 1.1 * expected_s).select("symbol", "seq", "gap_s")
