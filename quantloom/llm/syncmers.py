"""Document fingerprints from closed syncmers, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import boundaries, bucket_of, range_count

#: Symbols of a k-mer, symbols of the inner substring that must be minimal at an edge.
K, S = 5, 2

#: Bytes of text in a range of ids that one task reads, about.
RANGE_BYTES = 128 << 20

#: Bits of an anchor's position in a sketch.
POSITION_BITS = 28


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def symbols(text: Column) -> Column:
    """The alphabet of the k-mers: runs of up to 8 characters other than blanks, hashed, with K - 1 end marks on both sides.

    An unbroken run of over 32 characters has the 8 characters from each of its places instead, so that an insertion
    changes no symbols but those around it (in shorter runs, at most those of the run).
    """
    cut = lambda run: F.regexp_extract_all(run, F.lit(r"\S{1,8}"), F.lit(0))
    every = lambda run: F.regexp_extract_all(run, F.lit(r"(?=(\S{8}))\S"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    by_run = F.flatten(F.transform(runs, lambda run: F.when(F.char_length(run) > 32, every(run)).otherwise(cut(run))))
    hashed = F.transform(F.when(text.rlike(r"\S{33}"), by_run).otherwise(cut(text)), lambda w: F.xxhash64(w))
    mark = F.array_repeat(F.lit(0).cast("long"), K - 1)
    return let(hashed, lambda h: F.when(F.size(h) > 0, F.concat(mark, h, mark)).otherwise(F.array().cast("array<bigint>")))


def anchors(text: Column) -> Column:
    """Closed syncmers of a text as array<struct(position, hash)>, by position.

    A k-mer of ``K`` symbols is one if the least hash among its inner runs of ``S`` symbols is at its first or last
    place. That depends on the k-mer alone, so a passage has the same anchors wherever it stands; the gaps between
    equal anchors of two texts align them. Null and blank texts have none.
    """

    def select(h):
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))

        def closed(r):
            last = K - S

            def is_anchor(i):
                edge = F.least(F.get(r, i), F.get(r, i + last))
                inner = F.least(*(F.get(r, i + j) for j in range(1, last))) if last > 2 else F.get(r, i + 1)
                return edge <= inner

            at = F.filter(F.sequence(F.lit(0), F.size(h) - K), is_anchor)
            return F.transform(at, lambda i: F.struct(i.alias("position"), F.xxhash64(*(F.get(h, i + j) for j in range(K))).alias("hash")))

        return let(runs, closed)

    empty = F.array().cast("array<struct<position:int,hash:bigint>>")
    return F.coalesce(let(symbols(F.coalesce(text, F.lit(""))), lambda h: F.when(F.size(h) >= K, select(h)).otherwise(empty)), empty)


def _packed(found: Column) -> Column:
    return F.transform(found, lambda a: F.shiftleft(F.pmod(a["hash"], F.lit(1 << 32)), POSITION_BITS) + a["position"])


def sketch(text: Column) -> Column:
    """All anchors by position, each a long: 32 bits of its hash, then ``POSITION_BITS`` of its position."""
    return _packed(anchors(text))


def as_text(sketched: Column) -> Column:
    """A sketch as hexadecimal digits, 8 for the hash and 7 for the position of each anchor; empty for a text without anchors."""
    return F.lower(F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 15, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct anchors of the text with fewer that the other has in aligned runs, from sketches.

    A common anchor (at its first place in either text) is aligned if the common anchor before or after it lies at
    the same distance in both texts, so a passage counts wherever it stands and a contained text has about 1.
    1 if the sketches are equal, both empty too; 0 if one is empty.
    """
    place = (1 << POSITION_BITS) - 1

    def with_side(sketched, side):
        return F.transform(
            sketched, lambda x: F.shiftleft(F.shiftright(x, POSITION_BITS) * 2 + side, POSITION_BITS) + x.bitwiseAND(F.lit(place))
        )

    def key(x):
        """Hash and side."""
        return F.shiftright(x, POSITION_BITS)

    # ascending by hash, side, position
    both = F.sort_array(F.concat(with_side(a, 0), with_side(b, 1)))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (key(x) != key(F.get(s, i - 1))))

    def score(d):
        n_b = F.size(F.filter(d, lambda x: key(x) % 2 == 1))
        in_both = F.filter(F.sequence(F.lit(0), F.size(d) - 2), lambda i: (key(F.get(d, i)) % 2 == 0) & (key(F.get(d, i)) + 1 == key(F.get(d, i + 1))))
        spots = F.transform(in_both, lambda i: F.struct(F.get(d, i).bitwiseAND(F.lit(place)).alias("at"), F.get(d, i + 1).bitwiseAND(F.lit(place)).alias("other")))
        shifts = F.transform(F.sort_array(spots), lambda m: m["at"] - m["other"])
        aligned = lambda h: F.size(F.filter(h, lambda x, i: F.coalesce(x == F.get(h, i - 1), F.lit(False)) | F.coalesce(x == F.get(h, i + 1), F.lit(False))))
        return let(shifts, aligned) / F.least(n_b, F.size(d) - n_b)

    scored = let(let(both, first), score)
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(scored)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``anchors`` and ``fingerprint`` of ``text_col``; columns of these names are replaced.

    Equal texts have equal fingerprints; null and blank texts have no anchors and an empty fingerprint.
    """
    kept = [c for c in docs.columns if c not in ("anchors", "fingerprint")]
    out = docs.select(*kept, anchors(F.col(text_col)).alias("anchors"))
    return out.withColumn("fingerprint", as_text(_packed(F.col("anchors"))))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document and the next in descending id order.

    The last is followed by the first; rows with equal ids follow each other by the hash of their text, rows with a
    null id (texts null: empty) come after all others. Ids are cut into ranges; a range gets a copy of the row that
    the next lower range begins with, so that no row needs another task and texts are moved once; sketches are made
    afterwards and never moved.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    edges = boundaries(docs, "doc_id", buckets or range_count(docs, "text", RANGE_BYTES))
    # bucket 0 is the first in descending order; null ids go with the lowest ids
    keyed = docs.withColumn("bucket", F.lit(len(edges)) - bucket_of(F.col("doc_id"), edges)).withColumn("tie", F.xxhash64("text"))
    place = F.struct((-F.col("doc_id")).isNull().alias("nulls"), (-F.col("doc_id")).alias("down"), "tie")
    heads = keyed.groupBy("bucket").agg(F.min(place).alias("head")).collect()  # one row for each range
    heads = sorted((r["bucket"], r["head"]["down"], r["head"]["tie"]) for r in heads)
    first = heads[0][0] if heads else 0
    before = [heads[i - 1][0] for i in range(len(heads))]  # the range before the first is the last
    heads = [(b, None if down is None else -down, tie, to, 2 if b == first else 1) for (b, down, tie), to in zip(heads, before)]
    heads = docs.sparkSession.createDataFrame(heads, "h_bucket int, h_id long, h_tie long, h_to int, h_ghost int")
    is_head = (F.col("bucket") == F.col("h_bucket")) & F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie"))
    ghosts = keyed.join(F.broadcast(heads), is_head)  # as many rows as ranges
    ghosts = ghosts.select("doc_id", "text", F.col("h_to").alias("bucket"), "tie", F.col("h_ghost").alias("ghost"))
    rows = keyed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "tie")
    follow = rows.withColumn("next_text", F.lead("text").over(order)).where("ghost = 0")
    return follow.select("doc_id", "text", sketch(F.col("text")).alias("sketch"), "next_text", sketch(F.col("next_text")).alias("next_sketch"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by as many (or all) of the following text's first."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))
