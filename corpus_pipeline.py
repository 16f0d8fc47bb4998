"""From raw documents to a shard manifest: five stages, each over all that the one before kept.

1. language: rows without an identified language go.
2. near_duplicates: of every group of near copies (shingle sets similar by 0.8 or more)
   the smallest id stays.
3. decontaminate: documents with two or more benchmark items go; what remains of a
   single item is cut out of the text.
4. mix: sources are brought to their target weights; a document is there as often as
   the mix passes over it.
5. shard: contiguous shards of equal bytes; the result is the manifest.

Every stage takes tables with null ids, texts and sources, repeated rows and ids, further
columns of any name, and no rows at all. Null and letterless texts go in stage 1. Rows
are known by a hash of id and text: those equal in both are one document in stage 2,
and share their fate in stages 3 and 4. Ties go to the smaller id, null last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleflow.llm import decontaminate, language, mixing, near_dup, sharding
from tripleflow.llm.shared import among, release, stage, table

SHARDS = 8
SIMILAR = 80  # percent


def _inner(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that clash with none of ours, with a row_key; and the name that each column has there."""
    of = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*of.values()).withColumn("row_key", F.xxhash64(F.col(of["doc_id"]), F.col(of["text"]))), of


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs, language.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each_group(docs, SIMILAR)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, of = _inner(docs)
    found = decontaminate.find_contamination(inner.select("row_key", F.col(of["text"]).alias("text")), table(spark, sf_dir, "benchmark"), clean=True, id_col="row_key")
    hits = found.where(F.size("item_ids") > 0).groupBy(F.col("doc_id").alias("row_key")).agg(F.max(F.size("item_ids")).alias("items"), F.max("clean_text").alias("clean_text"))
    hits = stage(hits, "pipeline-hits")
    # most rows have no hit and stay where they are
    rows = inner.withColumn("some", among(hits, "row_key")(F.col("row_key")))
    left = rows.where("some").join(hits, "row_key", "left").where("items is null or items < 2 and length(trim(clean_text)) > 0")
    text = {of["text"]: F.coalesce("clean_text", of["text"])}
    chars = {of["n_chars"]: F.when(F.col("items").isNull(), F.col(of["n_chars"])).otherwise(F.length("clean_text"))} if "n_chars" in of else {}
    own = list(of.values())
    return rows.where("not some").select(own).unionAll(left.withColumns(text | chars).select(own)).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, of = _inner(docs)
    mixed = mixing.mix_curriculum(inner.select("row_key", F.col(of["text"]).alias("text"), F.col(of["source"]).alias("source")), id_col="row_key")
    passes = mixed.where(F.col("passes") > 0).groupBy("row_key").agg(F.max("passes").alias("passes"))
    rows = inner.join(passes, "row_key")
    return rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).select(list(of.values())).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_identified),
    ("near_duplicates", keep_one_of_each_group),
    ("decontaminate", keep_uncontaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Language identification, near duplicates and the windows of the benchmark are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        kept = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            release(docs)
        docs = kept
    return docs
