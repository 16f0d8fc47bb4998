"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, archives, decontaminate, language, lm, mixing, near_dup, oracles, sharding, suffix, toxicity
from .shared import fold, table


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op4_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_curriculum(table(spark, sf_dir, "documents"))
    return mixing.in_training_order(mixed)


def op8_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_adaptive_scan, op2_cross_entropy, op3_suffix_dedup, op4_noisy_channel, op5_super_minhash, op6_shard_bytes, op7_mix_curriculum, op8_cross_parse, op9_arc_to_warc, op10_fm_index)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
