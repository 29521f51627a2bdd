"""The ``opN_*`` queries: each operator with production parameters over its whole table.

None of them can be expressed in SQL as a whole; ``tests/llm`` holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, gam, isomedia, kdshard, licences, lzprint, mixing, packing, simhash, toxicity
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401


def tokenizer_path() -> str:
    """Where the public tokenizer lies on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op2_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.media_digest(isomedia.media_column(table(spark, sf_dir, "documents")))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op5_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.compare_with_next(table(spark, sf_dir, "documents"))


def op6_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("places")


def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdshard.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.score(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# columns of the operators above that SQL can express, each with its SQL in ``oracle``


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_iso_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_licence_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_grouping_genetic_packing, op3_iso_media, op4_context_tree, op5_lempel_ziv_fingerprint, op6_simhash_pigeonhole, op7_toxicity_automata, op8_licence_scan, op9_kd_tree_shards, op10_quality_additive, pipeline,
        mix_targets, media_payload, licence_base,
    )
}
