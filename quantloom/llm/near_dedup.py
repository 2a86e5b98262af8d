"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, prepare
from .components import connected_components
from .shingles import Shingler, Sketcher, banding, digest, odd_sketch

BINS = 252
FEATURES = "row_key long, doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>, odd array<long>"
SETS = "digest binary, shingles array<long>"


def _features(words: int, bands: int, rows: int):
    def run(batches):
        shingler, sketcher = Shingler(words), Sketcher(BINS, rows)
        for batch in batches:
            out = {name: [] for name in ("n_shingles", "digest", "bands", "bits", "odd")}
            for text in batch.column("text"):
                shingles = shingler(text.as_py())
                out["n_shingles"].append(len(shingles))
                if len(shingles):
                    signature = sketcher.signature(shingles)
                    out["digest"].append(digest(shingles))
                    out["bands"].append(sketcher.bands(signature)[:bands])
                    out["bits"].append(sketcher.bits(signature))
                    out["odd"].append(odd_sketch(shingles))
                else:
                    for name in ("digest", "bands", "bits", "odd"):
                        out[name].append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_key"),
                    batch.column("doc_id"),
                    pa.array(out["n_shingles"], pa.int64()),
                    pa.array(out["digest"], pa.binary()),
                    pa.array(out["bands"], longs),
                    pa.array(out["bits"], longs),
                    pa.array(out["odd"], longs),
                ],
                names=["row_key", "doc_id", "n_shingles", "digest", "bands", "bits", "odd"],
            )

    return run


def _sets(words: int, flush: int = 1 << 20):
    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            names, sets, held = [], [], 0
            for text in batch.column("text"):
                shingles = shingler(text.as_py())
                names.append(digest(shingles))
                sets.append(shingles.view(np.int64))
                held += len(shingles)
                if held > flush:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])
                    names, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])

    return run


def row_key(id_col: str, text_col: str):
    """Names a row by id and text, nulls included; rows equal in both are interchangeable."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull())


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: tuple[int, int] = (4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of ``threshold`` (a fraction) or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``, ``digest`` (names the shingle set),
    ``component`` (names the group, also where ids repeat) and ``row_key`` (names the row by id and text).

    1. One pass over the texts gives each row its set's digest, size, banded bucket keys and a bit sketch.
       Rows with one digest are one class, so copies are never paired.
    2. In each bucket of two or more classes one class is the centre; only (centre, member) pairs are candidates.
    3. Candidates that sizes or sketches do not rule out are confirmed on the full sets; links form components.
    4. Where a bucket's members lie in different components, its best linked member is the centre of a second star.
    5. Where they still do, those outside the bucket's largest component are compared with its members of other
       components, by size and sketch within the join, and what is left is confirmed: so links between members
       that no centre reaches are found too. A group that the stars joined is not paired any more.

    One set is read for all rows of a class. Null and blank texts have no shingles and stay alone. Equal rows get equal results. A null id counts as larger
    than any other: such a row is kept (as null) only if its component has no other id. An empty table gives an
    empty result; other columns of ``docs`` are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    share = threshold[0] / threshold[1]
    bands, rows = banding(share, BINS)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    features = materialize(
        docs.select("row_key", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_features(words, bands, rows), FEATURES), "features"
    )
    links = _links(docs, features, words, threshold)
    labels = connected_components(links)
    classes = features.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    named = materialize(named, "classes")
    components = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(components, "label").select("digest", "component_id", F.col("label").alias("component"))
    out = features.select("doc_id", "n_shingles", "digest", "row_key").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest", "component", "row_key")


def _differing(name: str, words: int):
    """Bits in which the sketches ``a_name`` and ``b_name`` differ."""
    return sum((F.bit_count(F.get(f"a_{name}", F.lit(i)).bitwiseXOR(F.get(f"b_{name}", F.lit(i)))) for i in range(words)), F.lit(0))


def _plausible(threshold: tuple[int, int], slack: float = 5.5):
    """True unless sizes or sketches rule out that the pair reaches the threshold t.

    Sets at t differ in at most (1 - t) / (1 + t) of their sizes' sum, and in no more bits of their odd sketches.
    Their MinHash bits differ with probability (1 - t) / 2 each; the allowance is that mean plus ``slack`` standard
    deviations of as many independent bins as the smaller set can fill.
    """
    num, den = threshold
    p = (1 - num / den) / 2
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    filled = F.least(small, F.lit(BINS)).cast("double")
    return (
        (small * den >= large * num)
        & (_differing("odd", 4) * (den + num) <= (den - num) * (F.col("a_n") + F.col("b_n")))
        & (_differing("bits", math.ceil(BINS / 64)) <= BINS * p + slack * BINS * math.sqrt(p * (1 - p)) / F.sqrt(filled))
    )


def _links(docs: DataFrame, features: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) between digests."""
    representative = (
        features.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("row_key", F.col("n_shingles").alias("n"), "bits", "odd", "bands")).alias("r"))
        .select("digest", "r.*")
    )
    representative = materialize(representative, "representatives")
    entries = representative.select("digest", F.explode("bands").alias("key"))
    crowded = entries.groupBy("key").agg(F.count("*").alias("members"), F.min("digest").alias("centre")).where("members > 1").select("key", "centre")
    members = materialize(entries.join(crowded, "key").select("key", "digest", "centre"), "members")
    # the texts of classes that share a bucket are read once more, for their full sets
    candidates = representative.join(members.select("digest").distinct(), "digest", "left_semi").select("row_key")
    texts = docs.join(candidates, "row_key", "left_semi").select(F.col("text").cast("binary").alias("text"))
    sets = materialize(texts.mapInArrow(_sets(words), SETS).dropDuplicates(["digest"]), "sets")
    sketches = representative.select("digest", "n", "bits", "odd")

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(c).alias(name if c == "digest" else c if c == "key" else f"{name}_{c}") for c in rows.columns))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The (a, b) of plausible ``pairs`` that are links."""
        for name in ("a", "b"):
            pairs = pairs.join(side(name, sets), name)
        pairs = pairs.withColumn("common", F.size(F.array_intersect("a_shingles", "b_shingles")).cast("long"))
        union = F.size("a_shingles") + F.size("b_shingles") - F.col("common")
        return pairs.where(threshold[1] * F.col("common") >= threshold[0] * union).select("a", "b")

    def starred(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for name in ("a", "b"):
            pairs = pairs.join(side(name, sketches), name)
        return confirm(pairs.where(_plausible(threshold)).select("a", "b"))

    def split_buckets(links: DataFrame) -> DataFrame:
        """(key, digest, label, most): members of the buckets that hold several components, and the largest of these."""
        labels = connected_components(links)
        placed = members.select("key", "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
        placed = placed.withColumn("label", F.coalesce("label", "digest"))
        sizes = placed.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key")
        split = sizes.agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("most.label").alias("most"))
        return materialize(placed.join(split, "key"), "split")

    links = materialize(starred(members.where("digest != centre").select(F.col("centre").alias("a"), F.col("digest").alias("b"))), "links")

    # a second star: the best linked member of a bucket against those outside its component
    placed = split_buckets(links)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("digest")).agg(F.count("*").alias("degree"))
    hubs = placed.join(degree, "digest").groupBy("key").agg(F.max(F.struct("degree", "digest", "label")).alias("hub")).select("key", "hub.digest", "hub.label")
    outside = placed.select("key", F.col("digest").alias("b"), F.col("label").alias("b_label"))
    again = hubs.select("key", F.col("digest").alias("a"), F.col("label").alias("a_label")).join(outside, "key").where("a_label != b_label").select("a", "b")
    links = materialize(links.union(starred(again)), "links")

    placed = split_buckets(links)
    placed = materialize(placed.join(representative.select("digest", "n", "bits", "odd", "bands"), "digest"), "placed")
    outside = side("a", placed.where("label != most").drop("most"))
    everyone = side("b", placed.withColumn("largest", F.col("label") == F.col("most")).drop("most"))
    across = (F.col("a_label") != F.col("b_label")) & (F.col("b_largest") | (F.col("a") < F.col("b"))) & _plausible(threshold)
    # a pair that meets in several buckets is taken in the first of them
    common = F.filter(F.zip_with("a_bands", "b_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    across = across & (F.get(common, F.lit(0)) == F.col("key"))
    pairs = outside.join(everyone, "key").where(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(links.union(confirm(pairs.distinct())), "links")
