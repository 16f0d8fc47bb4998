"""Checks on graphs, covers and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import settled, spread


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Triples of one side that the other lacks, with the side: both directions, counted."""
    side = lambda df, n: df.select("s", "p", "o", F.lit(n).alias("n"))
    both = settled(side(expected, 1).unionAll(side(found, -1)))
    excess = spread(both, both.count(), "s", "p", "o").groupBy("s", "p", "o").agg(F.sum("n").cast("int").alias("n")).where("n <> 0")
    return excess.select("s", "p", "o", F.when(F.col("n") > 0, "missing").otherwise("extra").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("n")).drop("n")


def unplaced(triples: DataFrame, cover: DataFrame) -> DataFrame:
    rows, keys = triples.count(), ["s", "p", "o"]
    return spread(triples, rows, *keys).join(spread(cover, rows, *keys), keys, "left_anti")


def wrong_owners(stats: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners that are not what the statistics say."""
    from .statistics import owners as computed

    right = computed(stats).withColumnRenamed("owner", "right")
    return owners.join(right, "term").where("owner <> right")


def balance(cover: DataFrame) -> DataFrame:
    """Size of each chunk, and its share of the mean in percent."""
    sizes = cover.groupBy("chunk").agg(F.count(F.lit(1)).alias("triples"))
    mean = sizes.agg(F.avg("triples").alias("mean"))
    return sizes.join(F.broadcast(mean), F.lit(True)).select("chunk", "triples", F.round(F.col("triples") * 100 / F.col("mean"), 2).alias("of_mean"))
