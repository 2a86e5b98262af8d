"""Keyed state with timers against the batch, restarts and restores; binary book files with pushed bounds."""

from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import scans as S
from quantloom.sources import book_files as BF
from quantloom.sources import readers
from quantloom.streaming import stateful

SCHEMA = "symbol string, seq long, ts timestamp, price double, volume double"


@pytest.fixture
def store(spark):
    was = spark.conf.get(stateful.STATE_STORE[0], None)
    spark.conf.set(*stateful.STATE_STORE)
    yield
    spark.conf.set(stateful.STATE_STORE[0], was) if was else spark.conf.unset(stateful.STATE_STORE[0])


def ticks(seed=1, n=400):
    r = np.random.default_rng(seed)
    out = []
    for symbol in ("a", "b"):
        at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(r.integers(10, 900, n)), unit="ms")
        out.append(pd.DataFrame({"symbol": symbol, "seq": np.arange(n), "ts": at, "price": 100 + np.cumsum(r.choice([-1, 0, 1], n)) * 0.01, "volume": r.integers(1, 60, n).astype(float)}))
    return pd.concat(out).sort_values("ts", kind="stable").reset_index(drop=True)


def last_ticks(frame):
    """One tick of each symbol an hour later, so that the watermark passes all others."""
    return pd.DataFrame({"symbol": ["a", "b"], "seq": [10**6] * 2, "ts": [frame["ts"].max() + pd.Timedelta(hours=1)] * 2, "price": [1.0] * 2, "volume": [1.0] * 2})


def put(spark, frame, path):
    spark.createDataFrame(frame, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, out, checkpoint, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = stateful.ordered_volume_buckets(stream, 500.0, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None


def buckets(df):
    return sorted((r.symbol, r.bucket, round(r.imbalance, 9)) for r in df.select("symbol", "bucket", "imbalance").collect())


def test_stream_with_a_restart_and_rows_out_of_order_equals_the_batch(spark, tmp_path, store):
    frame = ticks()
    expected = buckets(S.toxicity(spark.createDataFrame(frame, SCHEMA)))
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    # every third row comes a file later than the rows around it, within the allowed lateness
    late = frame.index % 3 == 0
    thirds = np.array_split(np.arange(len(frame)), 12)
    files = [pd.concat([frame.iloc[[i for i in part if not late[i]]], frame.iloc[[i for i in before if late[i]]]]) for part, before in zip([*thirds, np.array([], int)], [np.array([], int), *thirds])]
    for f in files[:5]:
        put(spark, f, source)
    run(spark, source, out, checkpoint, late="60 seconds")
    first = len(buckets(spark.read.parquet(out)))
    for f in [*files[5:], last_ticks(frame)]:
        put(spark, f, source)
    run(spark, source, out, checkpoint, late="60 seconds")  # goes on where it stopped
    assert buckets(spark.read.parquet(out)) == expected and 0 < first < len(expected)


def test_saved_totals_are_restored_unless_they_are_old(spark, tmp_path, store):
    frame = ticks(2)
    expected = buckets(S.toxicity(spark.createDataFrame(frame, SCHEMA)))
    half = frame["ts"].iloc[len(frame) // 2]
    old, new = frame[frame["ts"] <= half], frame[frame["ts"] > half]
    paths = {x: f"file://{tmp_path}/{x}" for x in ("in1", "out1", "check1", "in2", "out2", "check2", "in3", "out3", "check3", "saved")}
    put(spark, old, paths["in1"])
    put(spark, last_ticks(frame), paths["in1"])
    run(spark, paths["in1"], paths["out1"], paths["check1"])
    stateful.saved_totals(spark, paths["check1"]).write.parquet(paths["saved"])
    soon, later = (pd.Timestamp(half) + pd.Timedelta(seconds=s) for s in (60, 400))
    restored = readers.restored_state(spark, paths["saved"], soon.to_pydatetime())
    assert restored.count() == 2 and readers.restored_state(spark, paths["saved"], later.to_pydatetime()).count() == 0
    put(spark, new, paths["in2"])
    put(spark, last_ticks(frame), paths["in2"])
    run(spark, paths["in2"], paths["out2"], paths["check2"], restored=restored)
    both = spark.read.parquet(paths["out1"]).union(spark.read.parquet(paths["out2"]))
    assert buckets(both) == expected


def test_idle_totals_are_forgotten(spark, tmp_path, store):
    frame = ticks(3, 60)
    paths = {x: f"file://{tmp_path}/{x}" for x in ("in", "out", "check")}
    put(spark, frame, paths["in"])
    put(spark, last_ticks(frame), paths["in"])
    late = last_ticks(frame)
    late["ts"] += pd.Timedelta(hours=1)
    put(spark, late, paths["in"])
    run(spark, paths["in"], paths["out"], paths["check"], idle_s=600)
    assert all(r.at > frame["ts"].max() for r in stateful.saved_totals(spark, paths["check"]).collect())


def write_book(path, n, start, seed=0, extra=b"meta"):
    r = np.random.default_rng(seed)
    rec = np.zeros(n, BF.RECORD)
    rec["length"], rec["rtype"] = BF.RECORD.itemsize // 4, 10
    rec["ts_event"] = start + np.cumsum(r.integers(1000, 5_000_000, n))
    rec["sequence"], rec["depth"] = np.arange(n), r.integers(0, 3, n)
    rec["action"] = np.where(r.random(n) < 0.3, b"T", b"A")
    rec["price"] = np.where(r.random(n) < 0.05, BF.NO_PRICE, 100_000_000_000 + r.integers(0, 10**9, n))
    rec["size"] = r.integers(1, 100, n)
    for side, sign in (("bid", -1), ("ask", 1)):
        rec["levels"][f"{side}_px"] = 100_000_000_000 + sign * 10_000_000 * (1 + np.arange(10))
        rec["levels"][f"{side}_sz"] = r.integers(0, 5, (n, 10))
        rec["levels"][f"{side}_px"][r.random((n, 10)) < 0.2] = BF.NO_PRICE
    path.write_bytes(BF.header(extra) + rec.tobytes())
    return rec


def test_book_files_are_read_back(spark, tmp_path):
    assert BF.RECORD.itemsize == 368
    start = int(pd.Timestamp("2024-03-01").value)
    one, two = write_book(tmp_path / "AAA.mbp", 2500, start), write_book(tmp_path / "BBB.mbp", 700, start, 1, b"")
    d = BF.book_files(spark, str(tmp_path), records=600)
    rows = d.orderBy("symbol", "seq").collect()
    assert [r.symbol for r in rows] == ["AAA"] * 2500 + ["BBB"] * 700 and d.rdd.getNumPartitions() == 5 + 2
    for i in (0, 1, 599, 600, 2499):
        r, x = rows[i], one[i]
        assert (r.seq, r.depth, r.size, r.action) == (i, x["depth"], x["size"], x["action"].decode())
        assert r.price == (None if x["price"] == BF.NO_PRICE else x["price"])
        assert [tuple(v) for v in r.bids] == [(p, s) for p, s in zip(x["levels"]["bid_px"].tolist(), x["levels"]["bid_sz"].tolist()) if p != BF.NO_PRICE and s > 0]
        assert r.ts.replace(tzinfo=timezone.utc) == datetime.fromtimestamp(int(x["ts_event"]) // 1000 / 1e6, timezone.utc)
    assert rows[2500].size == two[0]["size"]
    exported = readers.book_export(d.where("price IS NOT NULL"))
    assert exported.where("volume > 0").count() == sum(((x["action"] == b"T") & (x["price"] != BF.NO_PRICE)).sum() for x in (one, two))
    assert exported.agg(F.max("bid")).first()[0] < 100


def test_book_files_seek_to_pushed_bounds(spark, tmp_path):
    start = int(pd.Timestamp("2024-03-01").value)
    rec = write_book(tmp_path / "AAA.mbp", 3000, start)
    low, high = (pd.Timestamp(int(rec["ts_event"][i]) // 1000 * 1000) for i in (1000, 1100))
    d = BF.book_files(spark, f"file://{tmp_path}/AAA.mbp", symbol="X", records=500)
    got = d.where((F.col("ts") >= F.lit(str(low))) & (F.col("ts") < F.lit(str(high))) & (F.col("depth") >= 0))
    us = rec["ts_event"].astype(np.int64) // 1000
    want = np.flatnonzero((us >= low.value // 1000) & (us < high.value // 1000))
    assert sorted(r.seq for r in got.collect()) == want.tolist() and got.first().symbol == "X"
    # the reader itself, with the same bounds: other ranges give nothing
    reader = BF.BookReader({"path": str(tmp_path / "AAA.mbp"), "records": "500"})
    kept = list(reader.pushFilters([BF.GreaterThanOrEqual(("ts",), low.to_pydatetime().replace(tzinfo=timezone.utc)), BF.LessThan(("ts",), high.to_pydatetime().replace(tzinfo=timezone.utc)), BF.EqualTo(("depth",), 1)]))
    assert len(kept) == 3
    counts = [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()]
    assert counts[0] == counts[1] == counts[3] == counts[5] == 0 and 100 <= counts[2] <= 102


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"not a book file")
    with pytest.raises(Exception, match="does not begin like a book file"):
        BF.book_files(spark, str(tmp_path)).count()
