"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, prepare
from .shingles import mixed

U = np.uint64
#: n-grams of 4 bytes, and of one and two words: two families, each hashed into buckets of its own.
BYTE_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 16
BUCKETS = BYTE_BUCKETS + WORD_BUCKETS
REPEAT = U(0xB5297A4D3F84D5B5)  # any pair of equal words is one feature, so that repetition is weighed as such


class NGrams:
    """Bucket numbers of a text's hashed n-grams; a blank or null text has none."""

    def __init__(self, remembered: int = 200_000):
        self.memo, self.remembered = {}, remembered

    def __call__(self, text: bytes | None) -> np.ndarray:
        if not text or not text.strip():
            return np.empty(0, np.int64)
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(b) >= 4:
            four = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
            four = (four * np.uint32(2654435761)) >> np.uint32(16)
        else:
            four = np.empty(0, np.uint32)
        memo, words = self.memo, text.split()
        if len(memo) > self.remembered:
            memo.clear()
        h = np.empty(len(words), U)
        for i, w in enumerate(words):
            x = memo.get(w)
            if x is None:
                x = memo[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = x
        two = np.where(h[1:] == h[:-1], REPEAT, mixed(h[:-1] * U(3) + h[1:]))
        shift = U(64 - int(math.log2(WORD_BUCKETS)))
        return np.concatenate([four.astype(np.int64), BYTE_BUCKETS + (np.concatenate([h, two]) >> shift).astype(np.int64)])


def labelled_sample(labels: DataFrame, most: int, seed: int = 5) -> dict[int, int]:
    """Quality of at most about ``most`` labelled documents, chosen by a seeded hash of the id (0 wins where labels differ)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    share = min(1.0, most / max(1, labels.count()))
    drawn = labels.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return {r["doc_id"]: r["quality"] for r in drawn.collect()}  # the share bounds it


def fit_ratio(docs: DataFrame, sample: dict[int, int], id_col: str, text_col: str, prior: float = 10.0) -> np.ndarray:
    """log p_target - log p_raw of every bucket: raw counts over all documents, target counts over the good ones of the sample.

    With t target counts where e are expected from the raw share, the ratio is (t + prior) / (e + prior): a gamma
    prior around 1, so that n-grams seen too rarely to tell say little. Every task adds up its own rows and sends
    one row for each bucket it met; the result has ``BUCKETS`` numbers.
    """
    good = np.array(sorted(k for k, v in sample.items() if v == 1), dtype=np.int64)

    def run(batches):
        grams = NGrams()
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1)):
                found = grams(text.as_py())
                if not len(found):
                    continue
                one = np.bincount(found, minlength=BUCKETS) if len(found) > 4096 else None
                rows = (0, 1) if doc_id is not None and len(good) and good[min(np.searchsorted(good, doc_id), len(good) - 1)] == doc_id else (0,)
                for row in rows:
                    if one is None:
                        np.add.at(counts[row], found, 1)
                    else:
                        counts[row] += one
        met = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(counts[0][met]), pa.array(counts[1][met])], names=["bucket", "raw", "target"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counted = source.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.zeros(BUCKETS)
    for part in (slice(0, BYTE_BUCKETS), slice(BYTE_BUCKETS, BUCKETS)):
        expected = raw[part] * (target[part].sum() / max(1.0, raw[part].sum()))
        ratio[part] = np.log((target[part] + prior) / (expected + prior))
    return ratio


def weigh(ratio: np.ndarray, found: np.ndarray, excerpt: int) -> float | None:
    """Log weight of a text from its buckets: the log ratio that ``excerpt`` n-grams of each family have on average; null without n-grams."""
    if not len(found):
        return None
    values, words = ratio[found], found >= BYTE_BUCKETS
    means = [float(part.sum()) / len(part) for part in (values[~words], values[words]) if len(part)]
    return excerpt * sum(means)


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, carry: list[str], excerpt: int) -> DataFrame:
    """The columns ``carry`` with ``log_weight`` (null without n-grams) and ``row_key``."""

    def run(batches):
        grams = NGrams()
        for batch in batches:
            weights = [weigh(ratio, grams(text.as_py()), excerpt) for text in batch.column("__text")]
            passed = batch.select([*carry, "row_key"]) if carry else batch.select(["row_key"])
            yield pa.RecordBatch.from_arrays([*passed.columns, pa.array(weights, pa.float64())], names=[*passed.schema.names, "log_weight"])

    source = docs.select(*carry, F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).cast("binary").alias("__text"))
    fields = [f"`{name}` {kind}" for name, kind in source.dtypes if name != "__text"]
    return source.mapInArrow(run, ", ".join([*fields, "log_weight double"]))


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise drawn by a seeded hash of the row."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, col: str, k: int, exact: int = 10_000, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, by histograms that narrow on it; null values do not count.

    Each pass counts ``bins`` ranges; values are fetched once at most ``exact`` of them are left in the range.
    """
    low, high, total = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not total or k < 1:
        return None
    if k >= total:
        return low
    above, left = 0, total
    while low < high:
        inside = df.where(F.col(col).between(low, high))
        if left <= exact:
            values = sorted((r[0] for r in inside.select(col).collect()), reverse=True)
            return values[k - above - 1]
        width = (high - low) / bins
        if low + width <= low or high - width >= high:
            return low
        place = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")
        counts = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high, left = r["low"], r["high"], r["n"]
                break
            above += r["n"]
    return low


def margin(good: list[float], bad: list[float]) -> float:
    """The cut between the weights of good and bad documents with the fewest errors of either rate, in the middle of its gap."""
    if not good or not bad:
        return -math.inf
    values = np.unique(np.array([*good, *bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmin(lost + passed)])


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    most_labels: int = 20_000,
    seed: int = 11,
    excerpt: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Columns ``carry`` (default: all) of every row of ``docs`` with ``log_weight, score, kept``.

    Two n-gram models are counted over the documents: raw from all of them, target from those that a sample of at
    most about ``most_labels`` rows of ``labels(doc_id, quality)`` calls good. ``log_weight`` is the log ratio of
    the two probabilities of an excerpt of ``excerpt`` n-grams of each family: texts of all lengths compare, and the
    excerpt is the temperature of the draw (the longer, the closer to a plain threshold). ``score`` adds standard
    Gumbel noise seeded by the row, and the k greatest scores are kept: a sample without replacement in proportion to
    the weights. k is the number of documents whose weight is above the cut between good and bad ones in a third of
    the sample that the models were not fitted on.

    Null and blank texts have a null weight and are not kept. Rows that tie with the k-th score are all kept, so
    equal rows get equal results. Without labels of both kinds every text with n-grams is kept. Columns named like
    the added ones are replaced; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    added = ("log_weight", "score", "kept", "row_key", "__text")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    sample = labelled_sample(labels, most_labels)
    held_out = {i: q for i, q in sample.items() if xxhash.xxh3_64_intdigest(str(i), seed) % 3 == 0}
    fitted = {i: q for i, q in sample.items() if i not in held_out}
    ratio = fit_ratio(docs, fitted, id_col, text_col) if any(fitted.values()) else np.zeros(BUCKETS)
    weighed = materialize(log_weights(docs, ratio, id_col, text_col, carry, excerpt), "weights")
    if held_out and id_col in carry:
        ids = docs.sparkSession.createDataFrame(list(held_out.items()), "__id long, __quality int")
        known = weighed.join(F.broadcast(ids), F.col(id_col) == F.col("__id")).where("log_weight is not null")  # as many rows as were sampled
        known = [(r["__quality"], r["w"]) for r in known.groupBy("__id", "__quality").agg(F.min("log_weight").alias("w")).collect()]
        cut = margin([w for q, w in known if q == 1], [w for q, w in known if q == 0])
    else:
        cut = -math.inf
    scored = weighed.withColumn("score", F.col("log_weight") + gumbel(F.col("row_key"), seed))
    k = scored.where(F.col("log_weight") > F.lit(cut)).count()
    least = kth_largest(scored, "score", k)
    kept = F.coalesce(F.col("score") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return scored.withColumn("kept", kept).drop("row_key")
