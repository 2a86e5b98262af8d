"""The corpus queries by name: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialize, shared_dir
from . import oracles
from .bpe import bpe_decode, bpe_encode
from .embedding_dedup import embedding_near_duplicates
from .lexical_search import SEGMENT_FILES, index_documents, search
from .line_dedup import drop_boilerplate_lines
from .near_dedup import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs
from .quality import importance_resample
from .sharding import shard_of, shuffled_shards
from .syncmers import as_text, edited, likeness, sketch, with_next
from .tier_packing import pack_token_tiers
from .token_store import read_documents, write_tokens
from .url_filter import host_and_path, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into bins of 2048 words."""
    return pack(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 85 % or more over three-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more between all vectors."""
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_directly_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all token ids as directly addressable codes and read every document back from the files."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_external_shuffle_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle all documents into eight shards chosen by doc_id."""
    shards, seed = 8, 17
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffled_shards(table(spark, sf_dir, "documents"), shards, seed).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    pairs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_sketch", sketch(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and decoded text."""
    encoded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return bpe_decode(encoded, tokenizer_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that are surely on over a hundredth of their source's pages."""
    return drop_boilerplate_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "dropped_lines")


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page url; a page's outcome is the quality label of the document that its path numbers."""
    pages = table(spark, sf_dir, "pages")
    judged = judge_urls(pages.select("page_id", "url"), page_outcomes(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the quality classifier keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, table(spark, sf_dir, "labels"), carry=["doc_id"]).select("doc_id", "log_weight", "kept")


def op11_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into windows of up to 4096, all of them powers of two."""
    packed = pack_token_tiers(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    segments = materialize(index_documents(table(spark, sf_dir, "documents")), "segments", **SEGMENT_FILES)
    return search(segments, table(spark, sf_dir, "benchmark"))


def op13_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four or more periods in every document, after one in ten has been made periodic from some word on."""
    found = periodic_runs(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    run = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("run", run).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("run.start")).alias("start"),
        F.col("run.length").alias("length"),
        (-F.col("run.period")).alias("period"),
        F.expr("1000 * run.length div -run.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def made_periodic(docs: DataFrame) -> DataFrame:
    """Documents of which those whose crc32 of the id ends in 0 repeat a stretch of their words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("words", F.when(F.col("g").isNotNull(), words))
    docs = docs.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")),
    )
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the labelled pages."""
    host, path = host_and_path(F.col("__url"))
    numbered = pages.withColumn("__url", F.col("url")).select(host.alias("host"), F.regexp_extract(path, r"^/[^/]*/(\d{1,18})", 1).alias("number"))
    numbered = numbered.where(F.col("number") != "").select("host", F.col("number").cast("long").alias("doc_id"))
    # one outcome for each labelled document: bad if any of its labels is
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return numbered.join(labels, "doc_id").select("host", (1 - F.col("quality")).alias("bad"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_directly_addressable_tokens": op4_directly_addressable_tokens,
    "op5_external_shuffle_sharding": op5_external_shuffle_sharding,
    "op6_closed_syncmers": op6_closed_syncmers,
    "op7_segment_tree_bpe": op7_segment_tree_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_reputation": op9_url_reputation,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_hierarchical_packing": op11_hierarchical_packing,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_periodic_run_detection": op13_periodic_run_detection,
}

#: The others hash, tokenize or search in ways that SQL cannot express; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": oracles.OP2,
    "op3_embedding_near_dedup": oracles.OP3,
    "op8_line_dedup": oracles.OP8,
    "op9_url_reputation": oracles.OP9,
    "op12_ranked_lexical_search": oracles.OP12,
}
