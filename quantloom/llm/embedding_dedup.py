"""Embedding near-duplicates: Euclidean p-stable hashing of normalised vectors, then exact cosines."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, prepare
from .components import connected_components

WIDTH = 2.0  # of a quantised projection, for vectors of length 1
SKETCH_BITS = 128


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection agrees for two points at a distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(count: int, cosine: float, missed: float = 1e-4) -> tuple[int, int]:
    """(projections, tables): about one unrelated vector in a bucket, and a pair at the threshold missed this rarely."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    projections = max(2, math.ceil(math.log(max(2, count)) / -math.log(far)))
    return projections, math.ceil(math.log(missed) / math.log1p(-(near**projections)))


@lru_cache(maxsize=8)
def _projections(dim: int, projections: int, tables: int, seed: int):
    r = np.random.default_rng([seed, dim])
    lines = r.standard_normal((dim, tables * projections))
    offsets = r.uniform(0, WIDTH, tables * projections)
    mix = r.integers(1, 1 << 63, size=(tables, projections), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    salt = r.integers(1, 1 << 63, size=tables, dtype=np.int64).astype(np.uint64)
    return lines, offsets, mix, salt, r.standard_normal((dim, SKETCH_BITS))


def _vectors(batches):
    """Digest and unit vector of every usable row."""
    for batch in batches:
        names, units = [], []
        for value in batch.column("vector"):
            raw = value.as_py()
            unit = None
            if raw and None not in raw:
                x = np.array(raw, dtype=np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    unit = x / math.sqrt(float(x @ x))
            units.append(unit)
            names.append(None if unit is None else hashlib.blake2b(np.array(raw, np.float64).tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(names, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "digest", "unit"]
        )


def _keys(projections: int, tables: int, seed: int):
    def run(batches):
        for batch in batches:
            keys, sketches = [], []
            for value in batch.column("unit"):
                unit = np.array(value.as_py())
                lines, offsets, mix, salt, planes = _projections(len(unit), projections, tables, seed)
                cells = np.floor((unit @ lines + offsets) / WIDTH).astype(np.int64).astype(np.uint64).reshape(tables, projections)
                x = (cells * mix).sum(axis=1, dtype=np.uint64) + salt
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                keys.append((x ^ (x >> np.uint64(29))).view(np.int64))
                sketches.append(np.packbits(unit @ planes > 0).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("least"), batch.column("copies"), batch.column("unit"), pa.array(keys, longs), pa.array(sketches, longs)],
                names=["digest", "least", "copies", "unit", "keys", "sketch"],
            )

    return run


def cosine_of(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors of one length; null if lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot)


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3) -> DataFrame:
    """Link vectors whose cosine is ``cosine`` or more: one row per input row (vec_id, n_links, component_id, kept).

    1. Equal vectors are one class with a number of copies.
    2. Each class gets a bucket key per table, a hash of quantised projections; the numbers of projections and
       tables follow the number of classes.
    3. Balls: in each bucket the least class is a centre; a class within half the angle of the threshold of a
       centre joins the ball of the least such one. All pairs inside a ball are links without being listed, so a
       large group of near copies costs its size, not its square.
    4. Balls that meet in a bucket are compared by their centres: the angle and the radii say that all pairs
       of them are links, or none is; only between these the members are compared, by exact cosines.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, as do vectors of
    different lengths. ``n_links`` counts the other rows linked directly, repeated rows each. A null id counts as
    larger than any other. An empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    prepare(spark)
    angle = math.acos(cosine)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = materialize(source.mapInArrow(_vectors, "vec_id long, digest binary, unit array<double>"), "vectors")
    usable = rows.where(F.col("digest").isNotNull())
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).join(
        usable.select("digest", "unit").dropDuplicates(["digest"]), "digest"
    )
    classes = materialize(classes, "classes")
    projections, tables = tables_for(classes.count(), cosine)
    keyed = materialize(
        classes.mapInArrow(_keys(projections, tables, seed), "digest binary, least long, copies long, unit array<double>, keys array<long>, sketch array<long>"), "keyed"
    )
    entries = keyed.select("digest", F.explode("keys").alias("key"))
    crowded = entries.groupBy("key").agg(F.min("digest").alias("centre"), F.count("*").alias("members")).where("members > 1").select("key", "centre")
    members = materialize(entries.join(crowded, "key"), "members")
    units = keyed.select("digest", "unit")

    def with_units(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(units.select(F.col("digest").alias(side), F.col("unit").alias(f"{side}_unit")), side)
        return pairs.withColumn("cosine", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_of(F.col("a_unit"), F.col("b_unit"))))).drop("a_unit", "b_unit")

    # balls
    stars = members.where("digest != centre").select(F.col("centre").alias("a"), F.col("digest").alias("b")).distinct()
    close = with_units(stars).where(F.col("cosine") >= math.cos(angle / 2) + 1e-9)
    close = materialize(close.select("a", "b", F.acos("cosine").alias("radius")), "close")
    leaders = close.select(F.col("a").alias("leader")).distinct().join(close.select(F.col("b").alias("leader")), "leader", "left_anti")
    ball_of = close.join(leaders, close["a"] == leaders["leader"]).groupBy(F.col("b").alias("digest")).agg(F.min(F.struct("leader", "radius")).alias("ball"))
    placed = keyed.select("digest", "least", "copies", "sketch").join(ball_of, "digest", "left").select(
        "digest", "least", "copies", "sketch", F.coalesce("ball.leader", "digest").alias("leader"), F.coalesce("ball.radius", F.lit(0.0)).alias("radius")
    )
    placed = materialize(placed, "placed")
    balls = placed.groupBy("leader").agg(F.sum("copies").alias("weight"), F.max("radius").alias("radius"), F.min("least").alias("least"))
    balls = materialize(balls.join(placed.select(F.col("digest").alias("leader"), "sketch"), "leader"), "balls")

    # balls that meet in a bucket, unless their centres' sketches rule a link out
    meeting = members.select("key", "digest").join(placed.select("digest", "leader"), "digest").select("key", "leader").distinct()
    meeting = meeting.join(balls.select("leader", "sketch", "radius"), "leader")
    sides = [meeting.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("leader", "sketch", "radius"))) for s in "ab"]
    apart = sum((F.bit_count(F.get("a_sketch", F.lit(i)).bitwiseXOR(F.get("b_sketch", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    share = F.least(F.lit(1.0), (angle + F.col("a_radius") + F.col("b_radius")) / math.pi)
    allowed = SKETCH_BITS * share + 6 * F.sqrt(SKETCH_BITS * share * (1 - share))
    pairs = sides[0].join(sides[1], "key").where((F.col("a_leader") < F.col("b_leader")) & (apart <= allowed))
    pairs = pairs.select(F.col("a_leader").alias("a"), F.col("b_leader").alias("b"), (F.col("a_radius") + F.col("b_radius")).alias("radii")).distinct()
    between = F.acos("cosine")
    verdict = (
        F.when(F.col("radii") == 0, F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
        .when(between + F.col("radii") <= angle - 1e-9, "all")
        .when(between - F.col("radii") > angle + 1e-9, "none")
        .otherwise("some")
    )
    pairs = materialize(with_units(pairs).select("a", "b", verdict.alias("verdict")).where("verdict != 'none'"), "pairs")
    some = pairs.where("verdict = 'some'").select(F.col("a").alias("a_ball"), F.col("b").alias("b_ball"))
    for side in ("a", "b"):
        some = some.join(placed.select(F.col("leader").alias(f"{side}_ball"), F.col("digest").alias(side), F.col("copies").alias(f"{side}_copies")), f"{side}_ball")
    some = materialize(with_units(some).where(F.col("cosine") >= cosine).select("a_ball", "b_ball", "a", "b", "a_copies", "b_copies"), "some")

    def both_ways(df: DataFrame, a: str, b: str, *more: tuple[str, str]) -> DataFrame:
        swap = {a: b, b: a} | {x: y for x, y in more} | {y: x for x, y in more}
        return df.unionByName(df.select(*(F.col(swap.get(c, c)).alias(c) for c in df.columns)))

    whole = both_ways(pairs.where("verdict = 'all'").select("a", "b"), "a", "b")
    whole = whole.join(balls.select(F.col("leader").alias("b"), "weight"), "b").groupBy(F.col("a").alias("leader")).agg(F.sum("weight").alias("from_balls"))
    single = both_ways(some.select("a", "b", "a_copies", "b_copies"), "a", "b", ("a_copies", "b_copies")).groupBy(F.col("a").alias("digest")).agg(F.sum("b_copies").alias("from_members"))
    edges = pairs.where("verdict = 'all'").select("a", "b").union(some.select(F.col("a_ball").alias("a"), F.col("b_ball").alias("b")).distinct())
    labels = connected_components(edges)
    grouped = balls.select("leader", "weight", "least").join(labels.withColumnRenamed("node", "leader"), "leader", "left").join(whole, "leader", "left")
    grouped = materialize(grouped.withColumn("label", F.coalesce("label", "leader")), "grouped")
    components = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    grouped = grouped.join(components, "label").select("leader", "component_id", (F.col("weight") - 1 + F.coalesce("from_balls", F.lit(0))).alias("links"))
    by_class = placed.select("digest", "leader").join(grouped, "leader").join(single, "digest", "left")
    by_class = by_class.select("digest", "component_id", (F.col("links") + F.coalesce("from_members", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("digest").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
