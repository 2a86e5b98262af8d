"""Binary files of ten-level book records as a Spark data source: a partition per range of records, read from its place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..cluster import ship_package

#: Fixed layout of a public record format: a 16-byte head, the event, and ten levels of 32 bytes, little-endian.
LEVEL = np.dtype([("bid_px", "<i8"), ("ask_px", "<i8"), ("bid_sz", "<u4"), ("ask_sz", "<u4"), ("bid_ct", "<u4"), ("ask_ct", "<u4")])
RECORD = np.dtype(
    [
        ("length", "u1"), ("rtype", "u1"), ("publisher", "<u2"), ("instrument", "<u4"), ("ts_event", "<u8"),
        ("price", "<i8"), ("size", "<u4"), ("action", "S1"), ("side", "S1"), ("flags", "u1"), ("depth", "u1"),
        ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4"), ("levels", LEVEL, 10),
    ]
)
MAGIC = b"DBN"
HEAD = 8  # magic, version, and the length of what follows them before the first record
NO_PRICE = 2**63 - 1
SCHEMA = "symbol string, seq long, ts timestamp, action string, depth int, price long, size long, bids array<struct<px: long, sz: long>>, asks array<struct<px: long, sz: long>>"


def header(extra: bytes = b"", version: int = 1) -> bytes:
    """What stands before the records."""
    return MAGIC + bytes([version]) + len(extra).to_bytes(4, "little") + extra


class Records(InputPartition):
    """Records ``low`` to ``high`` of a file whose first one stands at ``start``."""

    def __init__(self, path: str, start: int, low: int, high: int):
        self.path, self.start, self.low, self.high = path, start, low, high


class BookFiles(DataSource):
    """Options: ``path`` (a file or a folder, in any store that Arrow reads), ``symbol`` (default: the file's name up to the first dot), ``records`` per partition."""

    @classmethod
    def name(cls) -> str:
        return "bookfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BookReader(self.options)


def bound(f: Filter) -> tuple[str, int] | None:
    """(side, nanoseconds) of a filter on the time; none of any other."""
    sides = {GreaterThan: "low", GreaterThanOrEqual: "low", LessThan: "high", LessThanOrEqual: "high", EqualTo: "both"}
    if type(f) not in sides or tuple(f.attribute) != ("ts",) or f.value is None:
        return None
    at = np.datetime64(f.value.replace(tzinfo=None) - (f.value.utcoffset() or f.value - f.value), "us") if f.value.tzinfo else np.datetime64(f.value, "us")
    return sides[type(f)], int(at.astype("int64")) * 1000


class BookReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.symbol = options["path"], options.get("symbol")
        self.records = int(options.get("records", 200_000))
        self.low, self.high = 0, 2**64 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on the time for seeking; Spark applies all filters again."""
        for f in filters:
            found = bound(f)
            if found:
                side, at = found
                if side in ("low", "both"):
                    self.low = max(self.low, at)
                if side in ("high", "both"):
                    self.high = min(self.high, at + 999)  # Spark's times end at microseconds
            yield f

    def partitions(self) -> list[Records]:
        store, path = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa.fs.LocalFileSystem(), self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else [f for f in store.get_file_info(pa.fs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_"))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with store.open_input_file(f.path) as file:
                head = file.read_at(HEAD, 0)
            if head[:3] != MAGIC:
                raise ValueError(f"{f.path} does not begin like a book file")
            start = HEAD + int.from_bytes(head[4:8], "little")
            count = (f.size - start) // RECORD.itemsize
            name = self.path if info.is_file else f"{self.path.rstrip('/')}/{f.base_name}"
            out += [Records(name, start, low, min(low + self.records, count)) for low in range(0, count, self.records)]
        return out

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        store, path = pa.fs.FileSystem.from_uri(part.path) if "://" in part.path else (pa.fs.LocalFileSystem(), part.path)
        size = RECORD.itemsize
        with store.open_input_file(path) as file:

            def first_from(at: int) -> int:
                """The first record of the part whose time is not before ``at``; times ascend."""
                low, high = part.low, part.high
                while low < high:
                    mid = (low + high) // 2
                    if int(np.frombuffer(file.read_at(size, part.start + mid * size), RECORD)[0]["ts_event"]) < at:
                        low = mid + 1
                    else:
                        high = mid
                return low

            low, high = first_from(self.low) if self.low else part.low, first_from(self.high + 1) if self.high < 2**64 - 1 else part.high
            symbol = self.symbol or path.rsplit("/", 1)[-1].split(".")[0]
            for at in range(low, high, 10_000):
                count = min(10_000, high - at)
                yield decoded(np.frombuffer(file.read_at(count * size, part.start + at * size), RECORD), symbol)


def decoded(records: np.ndarray, symbol: str) -> pa.RecordBatch:
    """Arrow rows of records; the price that stands for none is null, and levels without price or size are left out."""
    sides = []
    for side in ("bid", "ask"):
        px, sz = records["levels"][f"{side}_px"], records["levels"][f"{side}_sz"].astype(np.int64)
        there = (px != NO_PRICE) & (px > 0) & (sz > 0)
        offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        levels = pa.StructArray.from_arrays([pa.array(px[there]), pa.array(sz[there])], names=["px", "sz"])
        sides.append(pa.ListArray.from_arrays(pa.array(offsets), levels))
    price = records["price"].astype(np.int64)
    columns = {
        "symbol": pa.array([symbol] * len(records)),
        "seq": pa.array(records["sequence"].astype(np.int64)),
        "ts": pa.array((records["ts_event"] // 1000).astype(np.int64)).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")),
        "action": pa.array(records["action"].astype("U1").tolist(), pa.string()),
        "depth": pa.array(records["depth"].astype(np.int32)),
        "price": pa.array(price, mask=price == NO_PRICE),
        "size": pa.array(records["size"].astype(np.int64)),
        "bids": sides[0],
        "asks": sides[1],
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def book_files(spark: SparkSession, path: str, symbol: str | None = None, records: int = 200_000) -> DataFrame:
    """The records of binary book files under ``path`` as rows for ``readers.book_export``.

    Each file is cut into ranges of ``records``, which tasks read from their place. Bounds on ``ts`` in filters are
    looked up by bisection in each range (records of a file ascend in time), so a range outside of them costs a few reads.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BookFiles)
    reader = spark.read.format("bookfiles").option("path", path).option("records", records)
    return (reader.option("symbol", symbol) if symbol else reader).load()
