"""Ranked lexical search: inverted segments of documents, searched best first over hierarchies of maxima."""

from __future__ import annotations

import math
from bisect import insort
from collections import defaultdict
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize, prepare

#: A-Z become a-z, and every byte that belongs to no term a blank: terms are runs of 0-9, A-Z, a-z and bytes from 0x80.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

SEGMENT = "doc_ids array<long>, sizes array<int>, n_terms long, terms array<binary>, df array<int>, places binary, counts binary"
#: To write segments by: each is a row group. Writers and readers of Parquet hold whole groups, else a hundred rows or what a file has.
SEGMENT_FILES = {"parquet.block.row.count.limit": 1}
LEAF, FAN = 8, 32  # documents to a leaf range, ranges to a range of the next level
BLOCK_TERMS = 4096  # distinct terms whose trees are held at once
NOWHERE = 1 << 63  # a null id comes after all others


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def index_documents(docs: DataFrame, segment_terms: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = 1 << 14) -> DataFrame:
    """Inverted segments of all documents, for ``search``: write them down, by ``SEGMENT_FILES``, to search them more than once.

    A segment holds consecutive documents until they have ``segment_terms`` terms or are ``segment_docs`` (a search holds a
    block's terms times a segment's documents), shortest documents first, so that neighbours weigh their terms alike. It lists their ids and sizes, and for each of its terms the number of documents
    that hold it; ``places`` and ``counts`` (little-endian unsigned 32-bit) are these documents and how often each
    holds the term, term by term. Texts without terms, and null ones, are in no segment. Ids may be null or repeated;
    other columns are not looked at; an empty table has no segments. No row moves: a task indexes what it reads.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def segment(ids, words, sizes, numbers):
        order = np.argsort(sizes, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        keys, times = np.unique(np.concatenate(words) * len(ids) + np.repeat(place, sizes), return_counts=True)
        held = np.bincount(keys // len(ids), minlength=len(numbers))
        row = {
            "doc_ids": pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
            "sizes": pa.array([np.array(sizes)[order]], pa.list_(pa.int32())),
            "n_terms": pa.array([sum(sizes)], pa.int64()),
            "terms": pa.array([list(numbers)], pa.list_(pa.binary())),
            "df": pa.array([held], pa.list_(pa.int32())),
            "places": pa.array([(keys % len(ids)).astype("<u4").tobytes()], pa.binary()),
            "counts": pa.array([times.astype("<u4").tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    def run(batches):
        ids, words, sizes, numbers = [], [], [], defaultdict(count().__next__)
        total = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                ids.append(doc_id)
                words.append(np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms)))
                sizes.append(len(terms))
                total += len(terms)
                if total >= segment_terms or len(ids) >= segment_docs:
                    yield segment(ids, words, sizes, numbers)
                    ids, words, sizes, numbers, total = [], [], [], defaultdict(count().__next__), 0
        if ids:
            yield segment(ids, words, sizes, numbers)

    return source.mapInArrow(run, SEGMENT)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, term, times): each item's terms; ``item`` names its text, so that unlike items may share an id."""
    source = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    source = source.select("item_id", F.xxhash64("text").alias("item"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = [terms_of(text.as_py()) for text in batch.column(2)]
            rows = pa.array([i for i, terms in enumerate(found) for _ in terms], pa.int64())
            terms = pa.array([t for terms in found for t in terms], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), terms], names=["item_id", "item", "term"])

    terms = source.mapInArrow(run, "item_id long, item long, term binary")
    return terms.groupBy("item_id", "item", "term").agg(F.count("*").alias("times"))


@dataclass
class Block:
    """Items that are searched together, and their distinct terms; ``items`` are (item_id, item, terms, weights)."""

    terms: list[bytes]
    items: list[tuple]


def blocks_of(rows: list, n_docs: int) -> list[Block]:
    """Items with their terms' weights, in blocks of at most ``BLOCK_TERMS`` terms (more only where one item has more)."""
    by_item: dict[tuple, list] = defaultdict(list)
    for r in rows:
        by_item[(r["item_id"], r["item"])].append((bytes(r["term"]), r["times"] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))))
    blocks, numbers, items = [], {}, []
    for (item_id, item), terms in by_item.items():
        if items and len(numbers) + len(terms) > BLOCK_TERMS:
            blocks.append(Block(list(numbers), items))
            numbers, items = {}, []
        at = [numbers.setdefault(term, len(numbers)) for term, _ in terms]
        items.append((item_id, item, np.array(at), np.array([w for _, w in terms], np.int64)))
    return blocks + [Block(list(numbers), items)] if items else blocks


class Trees:
    """The terms of a block in one segment: impacts by document, and a tree of maxima over document ranges per term.

    ``levels[0]`` has the largest impact of each term in each range of ``LEAF`` documents, every further level the
    largest in ``FAN`` ranges of the one below, up to a single range.
    """

    def __init__(self, block: Block, place: dict[bytes, int], df: np.ndarray, places: np.ndarray, counts: np.ndarray, damping: np.ndarray):
        n_docs = len(damping)
        ends = np.cumsum(df)
        at = [(number, place[term]) for number, term in enumerate(block.terms) if term in place]
        spans = [np.arange(ends[i] - df[i], ends[i]) for _, i in at]
        chosen = np.concatenate(spans) if spans else np.empty(0, np.int64)
        term = np.repeat(np.array([number for number, _ in at], np.int64), [len(s) for s in spans])
        docs, times = places[chosen].astype(np.int64), counts[chosen].astype(np.int64)
        impact = 1_000_000_000 * times // (1000 * times + 8 * damping[docs])
        leaves = -(-n_docs // LEAF)
        level = np.zeros((len(block.terms), leaves), np.int64)
        keys = term * leaves + docs // LEAF  # ascending
        if len(keys):
            first = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
            level.reshape(-1)[keys[first]] = np.maximum.reduceat(impact, first)
        self.levels = [level]
        while level.shape[1] > 1:
            wide = -(-level.shape[1] // FAN)
            level = np.pad(level, ((0, 0), (0, wide * FAN - level.shape[1]))).reshape(len(level), wide, FAN).max(axis=2)
            self.levels.append(level)
        order = np.argsort(docs, kind="stable")
        self.term, self.impact = term[order], impact[order]
        self.first = np.searchsorted(docs[order], np.arange(n_docs + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, weight: np.ndarray, doc_ids: list, k: int, best: list[tuple[int, int]]) -> None:
        """Put the documents that belong there into ``best``, up to k pairs (minus score, id) in ascending order.

        The range with the highest summed bound is opened next. A range whose bound equals the k-th score is opened
        too, as it may hold an equal score of a smaller id; below that the search ends. ``weight`` has the weights at
        the places of all terms of the block, 0 where the item lacks them.
        """
        top = len(self.levels) - 1
        root = int(weights @ self.levels[top][terms, 0])
        queue = [(-root, top, 0)]
        n_docs = len(doc_ids)
        while queue:
            bound, level, node = heappop(queue)
            if bound >= 0 or len(best) == k and bound > best[-1][0]:
                return
            if level == 0:
                low = node * LEAF
                edges = self.first[low : min(low + LEAF, n_docs) + 1]
                a, b = edges[0], edges[-1]
                sums = np.append(0, np.cumsum(weight[self.term[a:b]] * self.impact[a:b]))
                for place, score in enumerate((sums[edges[1:] - a] - sums[edges[:-1] - a]).tolist(), low):
                    doc_id = doc_ids[place]
                    entry = (-score, NOWHERE if doc_id is None else doc_id)
                    if score > 0 and (len(best) < k or entry < best[-1]):
                        insort(best, entry)
                        del best[k:]
                continue
            below = self.levels[level - 1][:, node * FAN : (node + 1) * FAN]
            for child, value in enumerate((weights @ below[terms]).tolist(), node * FAN):
                if value > 0 and (len(best) < k or -value <= best[-1][0]):
                    heappush(queue, (-value, level - 1, child))


def search(
    segments: DataFrame,
    items: DataFrame,
    k: int = 10,
    at_once: int = 1 << 20,
    norm: int = 75,
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: ``item_id, rank, doc_id, score``.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))) and a document's damping m is
    100 - norm + (norm * n * N) div L, for N documents with L terms, n of them its own. The score sums, over the item's
    terms with repeats, the weight times (1000000000 tf) div (1000 tf + 8 m). Equal scores rank by ascending id.

    ``segments`` come from ``index_documents``, best written down. Items go to the tasks in passes of about
    ``at_once`` pairs of item and term, a bounded number of bytes; a pass reads every segment, and a task carries each
    item's best scores from one segment to the next, so that later ones are cut off early. Equal rows of ``items`` are
    one item; unlike ones that share an id are ranked each; items without terms, or whose terms no document holds, have
    no rows. Documents that share an id rank each, a null id after all others; no documents give no rows.
    """
    spark = segments.sparkSession
    prepare(spark)
    totals = segments.agg(F.sum(F.size("doc_ids")).alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 1
    wanted = materialize(item_terms(items, item_col, text_col), "item-terms")
    held = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("held")).select(F.col("held.terms").alias("term"), F.col("held.df").alias("df"))
    df = held.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = materialize(wanted.join(df, "term"), "weighed-terms")
    passes = max(1, -(-weighed.count() // at_once))
    number = F.pmod(F.xxhash64("item_id", "item"), F.lit(passes))

    def one_pass(blocks: list[Block]) -> DataFrame:
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches):
            blocks = shared.value
            best = [[[] for _ in block.items] for block in blocks]
            for batch in batches:
                for row in range(batch.num_rows):
                    at = {c: batch.column(c)[row].as_py() for c in ("doc_ids", "terms", "places", "counts")}
                    sizes, df = (np.array(batch.column(c)[row].values, np.int64) for c in ("sizes", "df"))
                    place = {term: i for i, term in enumerate(at["terms"])}
                    damping = 100 - norm + norm * sizes * n_docs // n_terms
                    for block, found in zip(blocks, best):
                        trees = Trees(block, place, df, np.frombuffer(at["places"], "<u4"), np.frombuffer(at["counts"], "<u4"), damping)
                        weight = np.zeros(len(block.terms), np.int64)
                        for (_, _, terms, weights), top in zip(block.items, found):
                            weight[terms] = weights
                            trees.search(terms, weights, weight, at["doc_ids"], k, top)
                            weight[terms] = 0
            rows = [(i[0], i[1], None if d == NOWHERE else d, -s) for b, f in zip(blocks, best) for i, top in zip(b.items, f) for s, d in top]
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item", "doc_id", "score"])

        return segments.select("doc_ids", "sizes", "terms", "df", "places", "counts").mapInArrow(run, "item_id long, item long, doc_id long, score long")

    found = None
    for p in range(passes):
        rows = weighed.where(number == p).orderBy("item_id", "item", "term").collect()
        part = one_pass(blocks_of(rows, n_docs))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
