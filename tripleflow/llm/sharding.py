"""Byte-balanced contiguous shards from global prefix sums.

Rows are range-partitioned by id; every partition contributes one total; the
running sum of those totals gives each partition's offset, and a row's global
byte position decides its shard. Only one number per partition crosses
partitions, so there is no global window and no row is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign each row of ``docs`` to one of ``shards`` contiguous ranges of nearly equal bytes.

    Order is by id, ties by text hash; a null id sorts first; repeated rows each
    take their own place. A null text has no bytes, and every row weighs one byte
    more than its text, so empty texts are spread too. An empty table gives an
    empty result. Returns id, size, text_crc32, shard and slot (gapless from 0 in
    each shard); other columns of ``docs`` are not carried.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    placed = stage(
        rows.repartitionByRange(F.col("id").asc_nulls_first(), "text_crc32", "size").withColumn("part", F.spark_partition_id()),
        "shard-sizes",
    )
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"))
    # one row per range partition: the window below sees a few hundred numbers
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size")
    running = placed.withColumn("here", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # the middle of a row decides: a shard is off its target by half a row at most at either end
    middle = F.col("before") + F.col("here") - F.col("size") / 2
    cut = stage(
        running.join(F.broadcast(offsets), "part").select(
            "part", "id", "size", "text_crc32", F.least(F.floor(middle * shards / F.col("all_bytes")), F.lit(shards - 1)).cast("int").alias("shard")
        ),
        "shard-cut",
    )
    counts = cut.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    local = Window.partitionBy("part", "shard").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size")
    return (
        cut.withColumn("n", F.row_number().over(local))
        .join(F.broadcast(starts), ["shard", "part"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
    )
