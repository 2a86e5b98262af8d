"""Best-fit packing of documents into bins under conflicts of source and duplicate cluster."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, prepare

SEED = 23
MOST_TASKS = 100_000  # a task takes several groups beyond that, one after the other
PACKED = "doc_id long, source string, cluster long, piece int, start long, length long, bin_id long, bin_offset long"


class Bins:
    """Open bins in order of residual capacity, each with bitmaps of the sources and duplicate clusters it holds.

    Bit r of ``residuals`` is set while a bin has r left, so the tightest place for an item of length n is the least
    set bit from n on; the search goes on to the next one until a bin shares no bit with the item. ``without`` keeps
    such a map for each source of its own: the residuals of the bins that do not hold it.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals = 0
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.full: dict[int, int] = {}  # source bit: residuals at which every bin was seen to hold it

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for an item; a new bin if no open one is both large enough and compatible."""
        passed = self.full.get(source, 0)
        candidates = (self.residuals & ~passed) >> length
        at = length
        while candidates:
            step = (candidates & -candidates).bit_length() - 1
            candidates >>= step
            at += step
            holds_all = True
            for chosen in self.by_residual[at]:
                if self.sources[chosen] & source:
                    continue
                holds_all = False
                if not self.clusters[chosen] & cluster:
                    return self._put(chosen, at, length, source, cluster)
            if holds_all:
                self.full[source] = self.full.get(source, 0) | 1 << at
            candidates >>= 1
            at += 1
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        new = len(self.residual) - 1
        self._enter(new, self.capacity)
        return self._put(new, self.capacity, length, source, cluster)

    def _enter(self, chosen: int, residual: int) -> None:
        self.by_residual[residual].append(chosen)
        self.residuals |= 1 << residual
        keep = ~(1 << residual)
        for source, passed in self.full.items():
            if passed >> residual & 1 and not self.sources[chosen] & source:
                self.full[source] = passed & keep

    def _put(self, chosen: int, residual: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        place = self.by_residual[residual]
        place.remove(chosen)
        if not place:
            self.residuals &= ~(1 << residual)
        self.sources[chosen] |= source
        self.clusters[chosen] |= cluster
        left = self.residual[chosen] = residual - length
        if left:
            self._enter(chosen, left)
        return chosen, self.capacity - residual


def pack_group(lengths: list[int], sources: list[str], clusters: list[int | None], capacity: int) -> tuple[list[int], list[int]]:
    """(bins, offsets) of pieces in the order given: each goes to the tightest open bin that is compatible."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    counts = Counter(clusters)
    repeated = [c for c, n in counts.items() if n > 1 and c is not None]  # a cluster of one cannot conflict
    cluster_bit = {c: 1 << i for i, c in enumerate(repeated)}
    bins = Bins(capacity)
    places = [bins.place(n, source_bit[s], cluster_bit.get(c, 0)) for n, s, c in zip(lengths, sources, clusters)]
    return [b for b, _ in places], [o for _, o in places]


def pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, source_col: str, cluster_col: str | None) -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` words; a text without words has none."""
    words = F.size(F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.xxhash64(F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"[\x20\x09-\x0D]+", " ")))
    sized = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), cluster.alias("cluster"), words.alias("words")
    )
    cut = sized.where("words > 0").select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("words") / capacity).cast("int") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "source", "cluster", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("words") - start).alias("length"))


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    group: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
) -> DataFrame:
    """Pack all documents into bins of ``capacity`` words: one row per piece with its span, bin and offset in the bin.

    Returns ``doc_id, source, cluster, piece, start, length, bin_id, bin_offset`` (start and length in words). Longer
    texts are cut into pieces, of which all but the last fill a bin. No bin holds two pieces of one source or of one
    duplicate cluster. Clusters are those of ``cluster_col``, or else of equal texts but for case and blanks.

    Pieces are dealt without their texts into groups of about ``group`` by a seeded hash of the piece and its number
    among equal ones, whatever their source; each group is packed by itself, largest pieces first, ties by id, piece,
    source and cluster. So memory is bounded, and the same pieces give the same bins whatever tasks are run again.
    Null texts and texts without words have no piece; a null source is the source ''; a null cluster conflicts with
    nothing; a null id stays null; repeated rows are packed each; other columns are not looked at, whatever their
    names; an empty table gives no bins.
    """
    spark = docs.sparkSession
    prepare(spark)
    cut = pieces(docs, capacity, id_col, text_col, source_col, cluster_col)
    # equal pieces are counted first and numbered afterwards, so that many of them spread over the groups
    counted = cut.groupBy(*cut.columns).agg(F.count("*").alias("copies"))
    counted = materialize(counted, "pieces")
    total = counted.agg(F.sum("copies").alias("n")).first()["n"] or 0
    groups = max(1, -(-total // group))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    dealt = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "source", "cluster", "piece", "copy"), F.lit(groups)).cast("int")
    order = ("group", F.desc("length"), "doc_id", "piece", "source", "cluster")
    ordered = numbered.withColumn("group", dealt).repartition(min(groups, MOST_TASKS), "group").sortWithinPartitions(*order)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def packed():
            table = pa.Table.from_batches(held)
            bins, offsets = pack_group(*(table.column(c).to_pylist() for c in ("length", "source", "cluster")), capacity)
            number = table.column("group")[0].as_py()
            columns = [*(table.column(c).combine_chunks() for c in ("doc_id", "source", "cluster", "piece", "start", "length"))]
            columns += [pa.array([(number << 32) + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "cluster", "piece", "start", "length", "bin_id", "bin_offset"])

        for batch in batches:
            numbers = batch.column("group").to_numpy()
            for low, high in zip(edges := [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()], [*edges[1:], len(numbers)]):
                if held and high > low and held[0].column("group")[0].as_py() != numbers[low]:
                    yield packed()
                    held.clear()
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            yield packed()

    return ordered.mapInArrow(run, PACKED)
