"""Term dictionary: dense ids from 1 in the order of terms, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled

OWNER_BITS = 48


def build(triples: DataFrame) -> DataFrame:
    """(id, term) of every subject, property and object: ranges of terms are numbered apart and shifted by range totals."""
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()
    parts = settled(terms.repartitionByRange(F.col("term")).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select((F.col("before") + F.col("place")).alias("id"), "term")


def densify(ids: DataFrame, column: str = "id") -> DataFrame:
    """(id, dense): distinct ids numbered from 1 in their order."""
    distinct = ids.select(F.col(column).alias("id")).where(F.col("id").isNotNull()).distinct()
    parts = settled(distinct.repartitionByRange(F.col("id")).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("place")).alias("dense"))


def size(dictionary: DataFrame) -> int:
    return dictionary.count()


def encode(triples: DataFrame, dictionary: DataFrame, columns: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """Terms as ids; an unknown term is 0."""
    for c in columns:
        d = dictionary.select(F.col("id").alias(f"{c}_id"), F.col("term").alias(f"{c}_term"))
        triples = triples.join(d, F.col(c) == F.col(f"{c}_term"), "left").withColumn(c, F.coalesce(f"{c}_id", F.lit(0))).drop(f"{c}_id", f"{c}_term")
    return triples


def decode(encoded: DataFrame, dictionary: DataFrame, columns: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """Ids as terms; an unknown id is null."""
    for c in columns:
        d = dictionary.select(F.col("id").alias(f"{c}_id"), F.col("term").alias(f"{c}_term"))
        encoded = encoded.join(d, F.col(c) == F.col(f"{c}_id"), "left").withColumn(c, F.col(f"{c}_term")).drop(f"{c}_id", f"{c}_term")
    return encoded


def with_owner(encoded: DataFrame, owners: DataFrame, columns: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """Ids with the owner in their upper 16 bits; ``owners``: (id, owner)."""
    for c in columns:
        o = owners.select(F.col("id").alias("own_id"), "owner")
        encoded = encoded.join(o, F.col(c) == F.col("own_id"), "left").withColumn(c, F.shiftleft(F.coalesce("owner", F.lit(0)).cast("long"), OWNER_BITS).bitwiseOR(F.col(c))).drop("own_id", "owner")
    return encoded


def without_owner(column: str):
    return F.col(column).bitwiseAND((1 << OWNER_BITS) - 1)
