"""A training corpus from raw documents: quality, boilerplate lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.cluster import materialize
from quantloom.llm.line_dedup import drop_boilerplate_lines
from quantloom.llm.near_dedup import near_duplicates, row_key
from quantloom.llm.packing import pack
from quantloom.llm.quality import importance_resample

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance_resample(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those with nothing left go."""
    cleaned = drop_boilerplate_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("dropped_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    emptied = (F.col("dropped_lines") > 0) & (F.trim("text") == "")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Unlike documents that share an id are groups of their own and all stay; an id that is null comes after all others.
    Rows with one id and text are one document: that with the least of the other columns stays. Texts without words
    have no duplicates.
    """
    docs = docs.select(*COLUMNS)
    found = materialize(near_duplicates(docs.select("doc_id", "text")).select("doc_id", "row_key", "component"), "groups")
    grouped = found.where(F.col("component").isNotNull())
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nulls"), "doc_id", "row_key")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("__id"), F.col("first.row_key").alias("__key"))
    alone = found.where(F.col("component").isNull()).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    keyed = docs.withColumn("__row", row_key("doc_id", "text"))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
    kept = keyed.join(chosen.union(alone), same, "left_semi")
    # rows equal in id and text, of which each group keeps one
    repeated = materialize(grouped.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row_key").alias("__row")), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "__row", "left_semi").groupBy("__row", "doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(repeated, "__row", "left_anti").select(*COLUMNS).unionByName(once)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words: a row for each piece of a document."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicate), ("best-fit packing", packing)]

#: Hashed n-gram models, sketches and best-fit search are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
