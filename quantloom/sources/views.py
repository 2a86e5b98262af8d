"""Domain views over the star-schema tables: ticks, quotes, fills, trades, order log, state vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trade tick: symbol, seq, ts, price, volume and best quotes; order key (symbol, ts, seq)."""
    events = table(spark, sf_dir, "events").where("value > 0")
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("value").alias("price"),
        (k + 1).alias("volume"),
        (F.col("value") - 0.01).alias("bid"),
        (F.col("value") + 0.01).alias("ask"),
        (1 + (F.col("event_id") * 7) % 11).cast("double").alias("bid_size"),
        (1 + (F.col("event_id") * 5) % 13).cast("double").alias("ask_size"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided quote updates: even ids quote the bid, odd ids the ask."""
    events = table(spark, sf_dir, "events").where("value > 0 AND event_type IN ('view', 'click')")
    bid = F.col("event_id") % 2 == 0
    return events.select(
        F.col("user_id").alias("symbol"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(bid, F.col("value") - 0.01).alias("bid"),
        F.when(~bid, F.col("value") + 0.01).alias("ask"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed fills from order lines."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 50).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("double").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("fees"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_linenumber") % 4).alias("regime_id"),
        F.col("l_linestatus").alias("order_type"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 + (F.col("l_discount") - 0.05) / 10)).alias("arrival_price"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades with profit and loss, in order (ts, order_id, line)."""
    line = table(spark, sf_dir, "lineitem")
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    return line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 50).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("double").alias("qty"),
        pnl.alias("pnl"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_linenumber") % 4).alias("regime_id"),
        F.col("l_linestatus").alias("entry_reason"),
        F.col("l_quantity").cast("double").alias("hold"),
        (-F.col("l_tax") / 10).alias("mae_pct"),
        (F.col("l_discount") / 5).alias("mfe_pct"),
        (F.col("l_tax") * 10).alias("entry_entropy"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted orders."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderstatus").alias("event_type"),
        F.col("o_totalprice").alias("notional"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("reason"),
    )


#: The same views for DuckDB, as common table expressions.
SQL = {
    "ticks": """ticks AS (SELECT event_type AS symbol, event_id AS seq, ts, value AS price,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS volume, value - 0.01::DOUBLE AS bid, value + 0.01::DOUBLE AS ask,
      CAST(1 + (event_id * 7) % 11 AS DOUBLE) AS bid_size, CAST(1 + (event_id * 5) % 13 AS DOUBLE) AS ask_size FROM events WHERE value > 0)""",
    "quotes": """quotes AS (SELECT user_id AS symbol, event_id AS seq, ts,
      CASE WHEN event_id % 2 = 0 THEN value - 0.01::DOUBLE END AS bid, CASE WHEN event_id % 2 <> 0 THEN value + 0.01::DOUBLE END AS ask
      FROM events WHERE value > 0 AND event_type IN ('view', 'click'))""",
    "fills": """fills AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey % 50 AS symbol,
      CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity::DOUBLE AS qty, l_extendedprice / l_quantity AS price,
      l_extendedprice * l_tax / 100 AS fees, l_shipdate AS ts, l_linenumber % 4 AS regime_id, l_linestatus AS order_type,
      l_extendedprice / l_quantity * (1 + (l_discount - 0.05::DOUBLE) / 10) AS arrival_price FROM lineitem)""",
    "trades": """trades AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey % 50 AS symbol,
      CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity::DOUBLE AS qty,
      l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl, l_shipdate AS ts, l_linenumber % 4 AS regime_id, l_linestatus AS entry_reason,
      l_quantity::DOUBLE AS hold, -l_tax / 10 AS mae_pct, l_discount / 5 AS mfe_pct, l_tax * 10 AS entry_entropy FROM lineitem)""",
    "order_log": """order_log AS (SELECT o_orderkey AS order_id, o_custkey AS account, o_orderstatus AS event_type,
      o_totalprice AS notional, o_orderdate AS ts, o_orderpriority AS reason FROM orders)""",
}


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names)
