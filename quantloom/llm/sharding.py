"""Two-pass external shuffle: scatter records over memory-sized buckets by seeded hashes, then Fisher-Yates each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize

#: Buckets that a task shuffles one after the other; their rows are in memory together at most.
BUCKETS_A_TASK = 8

RESERVED = ("shard", "slot", "bucket", "position")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is greatest: with one more shard, rows move only to that one."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("draw"), s.alias("shard")))
    return F.array_max(draws)["shard"].cast("int")


def shuffled_shards(
    records: DataFrame,
    shards: int = 8,
    seed: int = 17,
    bucket_bytes: int = 8 << 20,
    key_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``records`` with ``shard, bucket, position, slot``: a random order within each shard.

    The key and the number of shards decide the shard (law ``key``). Pass 1 scatters the records of a shard
    uniformly over as many buckets as its bytes need to be of about ``bucket_bytes`` each. Pass 2 gathers one bucket
    at a time, puts it in a fixed order and applies a seeded Fisher-Yates shuffle; slots number the buckets of a
    shard one after the other, without gaps. How many buckets a task takes depends on the bytes alone, so the same
    records, seed and sizes give the same order in any session.

    Rows with a null key share a shard, rows with one key too; they are scattered by key and text, so such a group
    spreads over buckets unless the rows are equal in both. Null texts count no bytes. Columns named like the
    added ones are replaced. An empty table gives an empty result.
    """
    kept = [c for c in records.columns if c not in RESERVED]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1
    placed = records.select(*kept, shard_of(F.col(key_col), shards, seed).alias("shard"))
    total = records.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    scatter = F.xxhash64(F.lit(seed + 1), F.col(key_col), F.col(text_col))
    placed = placed.withColumn("bucket", F.pmod(scatter, F.lit(per_shard)).cast("int"))
    # written, so that the plan below does not join the records with an aggregate of themselves
    counts = materialize(placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows")), "bucket-rows")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))

    # a fixed order first, so that a bucket computed again after a lost executor is shuffled alike
    order = F.xxhash64(F.lit(seed + 2), F.col(key_col), F.col(text_col))
    others = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in records.select(*kept).dtypes]
    row = F.struct(F.struct(order, F.xxhash64(*others)).alias("order"), F.struct(*kept).alias("record"))
    scattered = placed.repartition(-(-shards * per_shard // BUCKETS_A_TASK), "shard", "bucket")
    gathered = scattered.groupBy("shard", "bucket").agg(F.collect_list(row).alias("rows")).sortWithinPartitions("shard", "bucket")
    by_order = F.array_sort("rows", lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    dealt = gathered.select("shard", "bucket", F.shuffle(by_order, F.lit(seed)).alias("rows"))
    dealt = dealt.join(offsets, ["shard", "bucket"]).select("shard", "bucket", "offset", F.posexplode("rows").alias("position", "row"))
    return dealt.select("row.record.*", "shard", "bucket", F.col("position").cast("long").alias("position"), (F.col("offset") + F.col("position")).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the result of ``shuffled_shards`` to one folder per shard, in slot order within each file."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
