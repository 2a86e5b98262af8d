"""Hierarchical packing of tokenized documents into windows of several context sizes."""

from __future__ import annotations

from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, prepare
from .groups import grouped
from .token_store import library_tokenizer

SEED = 41
MOST_TASKS = 100_000  # a task takes several groups beyond that, one after the other
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, tier int, sequence_id long, offset long, step_group long"


class Supply:
    """Pieces not yet placed, by length: a bitmap of the lengths there are, and a stack of pieces for each.

    A piece is (number, first token). Of equal lengths the piece put in last comes first.
    """

    def __init__(self, longest: int):
        self.lengths = 0
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]

    def put(self, length: int, piece: tuple[int, int]) -> None:
        self.stacks[length].append(piece)
        self.lengths |= 1 << length

    def _take(self, length: int) -> tuple[int, tuple[int, int]]:
        stack = self.stacks[length]
        piece = stack.pop()
        if not stack:
            self.lengths &= ~(1 << length)
        return length, piece

    def longest(self) -> tuple[int, tuple[int, int]]:
        return self._take(self.lengths.bit_length() - 1)

    def longest_within(self, room: int) -> tuple[int, tuple[int, int]] | None:
        found = (self.lengths & ((2 << room) - 1)).bit_length() - 1
        return self._take(found) if found > 0 else None

    def shortest(self) -> tuple[int, tuple[int, int]]:
        return self._take((self.lengths & -self.lengths).bit_length() - 1)


def pack_tiers(lengths: list[int], longest: int = 4096) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, first token, tokens); the tokens of each window add up to a power of two.

    Tiers are the powers of two up to ``longest``; a piece belongs to the least that holds it. The longest piece left
    opens a window of its tier, so tiers are packed from the longest down. The gap, less than half the window, takes
    the longest pieces of shorter tiers that fit; once none fits, the shortest piece left is cut to fill it and its
    rest goes back to the supply. When the supply ends, the last window is cut into windows of the powers of two that
    make up its tokens, so that nothing is padded.
    """
    supply = Supply(longest)
    for piece in range(len(lengths) - 1, -1, -1):
        supply.put(lengths[piece], (piece, 0))
    windows = []
    while supply.lengths:
        n, (piece, first) = supply.longest()
        gap = (1 << (n - 1).bit_length()) - n
        window = [(piece, first, n)]
        while gap and supply.lengths:
            found = supply.longest_within(gap)
            if found is None:
                n, (piece, first) = supply.shortest()
                supply.put(n - gap, (piece, first + gap))
                n = gap
            else:
                n, (piece, first) = found
            window.append((piece, first, n))
            gap -= n
        windows += [window] if not gap else powers_of_two(window)
    return windows


def powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window cut into windows whose tokens are the powers of two of its own number, largest first."""
    out, rest = [], list(reversed(window))
    total = sum(n for _, _, n in window)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, part = total & 1 << bit, []
        while room:
            piece, first, n = rest.pop()
            taken = min(n, room)
            part.append((piece, first, taken))
            if n > taken:
                rest.append((piece, first + taken, n - taken))
            room -= taken
        if part:
            out.append(part)
    return out


def balanced_steps(windows: list[list[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """The step group of each window: the largest first, each to the group with the fewest tokens, then the least attention.

    Attention is the sum of squares of the pieces' lengths. There are as many groups as ``step_tokens`` each need.
    """
    sizes = [sum(n for _, _, n in w) for w in windows]
    attention = [sum(n * n for _, _, n in w) for w in windows]
    loads = [(0, 0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    heapify(loads)
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-sizes[i], -attention[i], i)):
        tokens, cost, group = loads[0]
        out[i] = group
        heapreplace(loads, (tokens + sizes[i], cost + attention[i], group))
    return out


def counted_documents(docs: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    """(doc_id, text, copies): rows that are equal in both and more than ``hot`` come once with their number, others with 1.

    So equal rows, which no hash can tell apart, are few wherever they meet.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = plain.withColumn("tie", F.xxhash64("text"))
    many = materialize(keyed.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")), "hot-rows")
    if many.isEmpty():
        return plain.withColumn("copies", F.lit(1).cast("long"))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie"))
    alone = keyed.join(many, same, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    return alone.union(keyed.join(many, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies")))


def pack_token_tiers(
    docs: DataFrame,
    tokenizer_path: str,
    longest: int = 4096,
    end_id: int = 2,
    step_tokens: int = 1 << 16,
    group_bytes: int = 4 << 20,
    hot_rows: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenize every text, append ``end_id``, and pack all tokens into windows of 1 to ``longest`` tokens, powers of two.

    One row per piece: ``doc_id``, ``start`` (tokens of the document before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``tier`` (the window's size), ``sequence_id``, ``offset`` in it and
    ``step_group``. Pieces of a sequence lie one after the other from 0 and fill it, so no window needs padding.

    Documents are cut at multiples of ``longest``; these pieces are dealt by a seeded hash into groups of about
    ``group_bytes`` of text, and each group is packed by itself (see ``pack_tiers``), so memory is bounded and a task
    that runs again gives the same windows. A step group holds windows of one such group with about ``step_tokens``
    tokens, near equal in tokens and in attention.

    Null and empty texts are the end id alone; a null id stays null; equal rows are packed each, and where more than
    ``hot_rows`` are equal in id and text they are tokenized once and dealt as numbered copies; other columns are not
    looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    counted = counted_documents(docs, id_col, text_col, hot_rows)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long") + 1).alias("bytes")).first()["bytes"] or 0
    groups = max(1, -(-total // group_bytes))

    def tokenize(batches):
        tokenizer = library_tokenizer(tokenizer_path)
        end, width = np.array([end_id], tokenizer.dtype).tobytes(), tokenizer.dtype.itemsize
        for batch in batches:
            rows, starts, sizes, ids = [], [], [], []
            for row, found in enumerate(tokenizer(batch.column("text").to_pylist())):
                data = found + end
                for at in range(0, len(data), longest * width):
                    rows.append(row)
                    starts.append(at // width)
                    sizes.append(len(data) // width)
                    ids.append(data[at : at + longest * width])
            taken = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(taken) for c in ("doc_id", "tie", "copies")]
            columns += [pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.full(len(rows), width, np.int32)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "copies", "start", "doc_tokens", "width", "ids"])

    def pack(batches):
        for table in grouped(batches, "group"):
            number, width = table.column("group")[0].as_py(), table.column("width")[0].as_py()
            doc_ids, starts, sizes, ids = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
            windows = pack_tiers([len(x) // width for x in ids], longest)
            steps = balanced_steps(windows, step_tokens)
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "tier", "sequence_id", "offset", "step_group")}
            for n, (window, step) in enumerate(zip(windows, steps)):
                offset, tier = 0, sum(k for _, _, k in window)
                for piece, first, k in window:
                    data = np.frombuffer(ids[piece], f"<u{width}", k, first * width).astype("<u4").tobytes()
                    row = (doc_ids[piece], starts[piece] + first, k, data, sizes[piece], tier, (number << 32) + n, offset, (number << 32) + step)
                    for column, value in zip(out.values(), row):
                        column.append(value)
                    offset += k
            kinds = {"ids": pa.binary(), "tier": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))

    tokens = counted.select("doc_id", F.xxhash64("text").alias("tie"), "copies", F.col("text").cast("binary").alias("text")).mapInArrow(
        tokenize, "doc_id long, tie long, copies long, start long, doc_tokens long, width int, ids binary"
    )
    copies = tokens.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    dealt = copies.withColumn("group", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "tie", "start", "copy"), F.lit(groups)).cast("int"))
    ordered = dealt.repartition(min(groups, MOST_TASKS), "group").sortWithinPartitions("group", "doc_id", "tie", "start", "copy")
    return ordered.select("group", "doc_id", "start", "doc_tokens", "width", "ids").mapInArrow(pack, PACKED)
