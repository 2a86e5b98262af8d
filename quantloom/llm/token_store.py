"""Token-id output as directly addressable codes: tokenize, write in id order, read any document or token back."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import materialize, prepare
from .dac import Segment, encode
from .ranges import boundaries, range_count
from .words import Memo, cut

SEGMENT = "bucket int, segment int, inside long, n_ids long, doc_ids array<long>, starts array<long>, data binary"


MOST_RANGES = 1_000_000  # whose totals are broadcast; more are joined


class LibraryTokenizer:
    """The tokenizers library over whole texts; words, which no token spans, are encoded once and remembered.

    A-Z are lower-cased first where the library does so, and texts are cut at blanks and before punctuation that
    follows a letter or digit, where a piece ends in any case. Words not met before go to the library as one text with
    ``0`` between them, whose id tells where each ends. A text with a mark that begins a special token goes there as
    it is. Ids come as little-endian unsigned integers of ``dtype``: two bytes where the vocabulary allows it.
    """

    def __init__(self, path: str, remembered_bytes: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks; threads of the library would only compete
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode_batch, self.memo = tokenizer.encode_batch_fast, Memo(remembered_bytes)
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.marks = tuple({t.content[:2].encode() for t in tokenizer.get_added_tokens_decoder().values()})
        lowered = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        self.lower = bytes.lower if lowered else bytes
        zero = tokenizer.encode("0", add_special_tokens=False).ids
        self.zero = zero[0] if len(zero) == 1 else None

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids of strings by the library, one by one."""
        encoded = self.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of strings without blanks and zeros, encoded as one text."""
        text = b" 0 ".join(words).decode("utf-8", "replace")
        ids = np.array(self.encode_batch([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == self.zero).tolist()
        if len(ends) != len(words) - 1:
            return self._whole(words)
        data, size = ids.tobytes(), self.dtype.itemsize
        return [data[a * size : b * size] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)])]

    def _learn(self, words: list[bytes]) -> None:
        """Put the ids of new words into the memory."""
        plain = [w for w in words if b"0" not in w] if self.zero is not None else []
        odd = [w for w in words if b"0" in w] if plain else words
        for group, encode_group in ((plain, self._together), (odd, self._whole)):
            if group:
                for word, ids in zip(group, encode_group(group)):
                    self.memo.put(word, ids)

    def __call__(self, texts: list[bytes | None], at_once: int = 4 << 20) -> list[bytes]:
        """Ids of each text; null is empty. Texts are taken in groups of about ``at_once`` bytes, which bounds the words held."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(text)
            held += len(text or b"")
            if held >= at_once:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    def _group(self, texts: list[bytes | None]) -> list[bytes]:
        memo, marks = self.memo, self.marks
        marked = [i for i, text in enumerate(texts) if text and any(m in text for m in marks)]
        runs = [cut(self.lower(text)) if text else [] for text in texts]
        for i in marked:
            runs[i] = []
        words: set[bytes] = set()
        for run in runs:
            words.update(run)
        self._learn(memo.missing(words))
        out = [b"".join(map(memo.young.__getitem__, run)) for run in runs]
        for i, ids in zip(marked, self._whole([texts[i] for i in marked]) if marked else ()):
            out[i] = ids
        memo.trim()
        return out


@lru_cache(maxsize=2)
def library_tokenizer(path: str) -> LibraryTokenizer:
    return LibraryTokenizer(path)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    segment_ids: int = 1 << 20,
    chunk_bits: int = 8,
    range_bytes: int = 256 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Tokenize every text, append ``end_id``, and write the ids in ascending id order to ``path``.

    ``path`` becomes a table of segments; ``data`` of each row is one file image in the format of ``dac``, with the
    ids and places of its documents beside it. A segment closes at ``segment_ids`` ids, a document never spans two.
    Null texts count as empty (the end id alone). Rows with a null id come first; rows with equal ids follow each
    other by the hash of their text. Other columns are not looked at. An empty table writes no segment.
    """
    spark = docs.sparkSession
    prepare(spark)
    edges = np.array(boundaries(docs, id_col, range_count(docs, text_col, range_bytes)), dtype=np.int64)

    def tokenize(batches):
        tokenizer = library_tokenizer(tokenizer_path)
        end = np.array([end_id], tokenizer.dtype).tobytes()
        for batch in batches:
            keys = batch.column("doc_id")
            values = np.array([-(1 << 63) if k is None else k for k in keys.to_pylist()], dtype=np.int64)
            ids = pa.array([found + end for found in tokenizer(batch.column("text").to_pylist())], pa.binary())
            width = pa.array(np.full(len(values), tokenizer.dtype.itemsize, np.int32))
            buckets = np.searchsorted(edges, values, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), keys, batch.column("tie"), width, ids], names=["bucket", "doc_id", "tie", "width", "ids"])

    def pack(batches):
        held: dict = {"docs": [], "starts": [], "ids": []}
        state = {"bucket": None, "segment": 0, "inside": 0, "n": 0}

        def flush():
            if not held["docs"]:
                return None
            row = [state["bucket"], state["segment"], state["inside"], state["n"], held["docs"][:], held["starts"][:], encode(np.concatenate(held["ids"]), chunk_bits)]
            for part in held.values():
                part.clear()
            state["segment"], state["inside"], state["n"] = state["segment"] + 1, state["inside"] + state["n"], 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["bucket", "segment", "inside", "n_ids", "doc_ids", "starts", "data"])

        for batch in batches:
            for bucket, doc_id, width, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "width", "ids"))):
                if bucket != state["bucket"] or state["n"] >= segment_ids:
                    if out := flush():
                        yield out
                    if bucket != state["bucket"]:
                        state |= {"bucket": bucket, "segment": 0, "inside": 0}
                ids = np.frombuffer(data, f"<u{width}")
                held["docs"].append(doc_id)
                held["starts"].append(state["n"])
                held["ids"].append(ids.astype(np.uint32))
                state["n"] += len(ids)
        if out := flush():
            yield out

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    ids = source.mapInArrow(tokenize, "bucket int, doc_id long, tie long, width int, ids binary")
    ordered = ids.repartition(len(edges) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "tie")
    ordered.mapInArrow(pack, SEGMENT).write.option("compression", "uncompressed").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The written segments with ``first``, the number of ids in all segments before each.

    The writer knows how many of a bucket's ids stand before a segment; the buckets' totals, a row for each range of
    the writer (``range_bytes`` of text), are summed up and sent to the segments, which stay where they are.
    """
    stored = spark.read.schema(SEGMENT).parquet(path)
    totals = stored.groupBy("bucket").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = materialize(totals.select("bucket", F.coalesce(before, F.lit(0)).alias("bucket_first")), "bucket-totals")
    joined = stored.join(F.broadcast(totals) if totals.count() <= MOST_RANGES else totals, "bucket")
    return joined.withColumn("first", F.col("bucket_first") + F.col("inside")).drop("bucket_first", "inside")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every written document: (doc_id, start, n_tokens, ids), start being its place among all ids of the files."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            for first, count, docs, starts, data in zip(*(batch.column(c) for c in ("first", "n_ids", "doc_ids", "starts", "data"))):
                segment, starts = Segment(data.as_py()), starts.as_py()
                ends = [*starts[1:], count.as_py()]
                flat = segment.slice(0, len(segment)).astype("<u4", copy=False)  # every document is wanted: one run
                ids = [flat[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs.as_py(), pa.int64()),
                        pa.array([first.as_py() + a for a in starts], pa.int64()),
                        pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    source = segments(spark, path).select("first", "n_ids", "doc_ids", "starts", "data")
    return source.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The id at each ``places(place)``, a place among all ids: (place, id); places outside the files are left out.

    A place meets the segments of its cell of a million places; one chunk per level is read there.
    """
    prepare(spark)
    cell = 1 << 20
    found = segments(spark, path)
    last = F.col("first") + F.col("n_ids") - 1
    index = found.select("bucket", "segment", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(last / cell))).alias("cell"))
    wanted = places.select("place", F.floor(F.col("place") / cell).alias("cell")).join(index, "cell").where(F.col("place").between(F.col("first"), F.col("last")))

    def run(batches):
        for batch in batches:
            out = [Segment(d.as_py())[p.as_py() - f.as_py()] for p, f, d in zip(*(batch.column(c) for c in ("place", "first", "data")))]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.int64())], names=["place", "id"])

    joined = wanted.join(found.select("bucket", "segment", "data"), ["bucket", "segment"])
    return joined.select("place", "first", "data").mapInArrow(run, "place long, id long")
