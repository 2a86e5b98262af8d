"""Sinks: tick store, event log, ledgers and reports, all by Spark's committed writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_ticks(ticks: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by symbol, in order of time within each file, so that a range of time skips row groups; a hot symbol is many tasks and files."""
    ticks.repartitionByRange("symbol", "ts", "seq").sortWithinPartitions("symbol", "ts", "seq").write.mode(mode).partitionBy("symbol").parquet(path)


def store_regimes(regimes: DataFrame, path: str, mode: str = "append") -> None:
    """(symbol, ts, regime_id, confidence, entropy) in order of time; an unknown regime is -1."""
    d = regimes.select("symbol", "ts", F.coalesce("regime_id", F.lit(-1)).cast("long").alias("regime_id"), "confidence", "entropy")
    d.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode(mode).parquet(path)


def save_state(states: DataFrame, path: str, now) -> None:
    """Append a snapshot of the states of all keys, stamped ``saved_at``."""
    states.withColumn("saved_at", F.lit(now).cast("timestamp")).write.mode("append").parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows to a delimited ledger with a header."""
    rows.write.mode("append").csv(path, header=True)


def replay_ledger(rows: DataFrame) -> DataFrame:
    """Positions, fees and fills of a ledger: (symbol, position, fees, fills) of its FILL rows."""
    f = rows.where("event_type = 'FILL'")
    signed = F.when(F.col("side") == "BUY", F.col("qty").cast("double")).otherwise(-F.col("qty").cast("double"))
    return f.groupBy("symbol").agg(F.sum(signed).alias("position"), F.sum(F.col("fees").cast("double")).alias("fees"), F.count("*").alias("fills"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document for each row."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
