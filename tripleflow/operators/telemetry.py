"""Interval aggregation of an event log: every ``interval`` events give a row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled


def numbered(events: DataFrame, order: str) -> DataFrame:
    """``events`` with ``n``, their place from 0: ranges are counted apart and shifted by their totals."""
    parts = settled(events.repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = totals.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("place", place).join(F.broadcast(before), "part").withColumn("n", F.col("before") + F.col("place")).drop("part", "place", "before")


def rounded(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def intervals(events: DataFrame, order: str, file: str, interval: int, metrics: dict[str, Column]) -> DataFrame:
    """(bucket, file, first, last, events, each metric): ``metrics`` are aggregates over a file's events in an interval."""
    rows = numbered(events, order).withColumn("bucket", F.floor(F.col("n") / interval))
    ends = rows.groupBy("bucket").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("all"))
    own = rows.groupBy("bucket", F.col(file).alias("file")).agg(F.count(F.lit(1)).alias("events"), *[m.alias(k) for k, m in metrics.items()])
    return own.join(ends, "bucket")


def access_rate(per_file: DataFrame) -> DataFrame:
    """Share of each file in an interval's events, in percent."""
    return per_file.select("bucket", "file", rounded(F.col("events") * 100 / F.col("all")).alias("access_rate"))


def interval_records(per_file: DataFrame, metrics: list[str]) -> DataFrame:
    """Every interval as two rows with equal values, at its first and its last event."""
    return per_file.select("file", F.explode(F.array("first", "last")).alias("row_id"), *metrics)


def access_counts(events: DataFrame, order: str, file: str, block: Column, interval: int) -> DataFrame:
    rows = numbered(events, order).withColumn("bucket", F.floor(F.col("n") / interval))
    return rows.groupBy("bucket", F.col(file).alias("file"), block.alias("block")).agg(F.count(F.lit(1)).alias("accesses"))


def switches(events: DataFrame, order: str, is_switch: Column) -> DataFrame:
    """Places of the events that switch chunks."""
    return numbered(events, order).where(is_switch).select(F.col("n").alias("position"))


def flow(events: DataFrame, source: Column, target: Column, reason: Column) -> DataFrame:
    return events.groupBy(source.alias("source"), target.alias("target"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def storage_states(events: DataFrame, order: str, file: str, in_file: Column) -> DataFrame:
    """(on_disk, in_memory): files by the state of their latest event."""
    last = events.groupBy(file).agg(F.max_by(in_file, order).alias("disk"))
    return last.agg(F.count(F.when(F.col("disk"), 1)).alias("on_disk"), F.count(F.when(~F.col("disk"), 1)).alias("in_memory"))


def storage_series(events: DataFrame, order: str, file: str, in_file: Column) -> DataFrame:
    """(n, on_disk, in_memory) after each event: files by the state of their latest event so far.

    Each event changes the two counts by -1, 0 or 1; the running sums are taken within
    ranges of events and shifted by the totals of the ranges before.
    """
    rows = numbered(events.withColumn("disk", in_file), order)
    before = F.lag("disk").over(Window.partitionBy(file).orderBy("n"))
    now = F.col("disk").cast("long")
    change = rows.select("n", (now - F.coalesce(before.cast("long"), F.lit(0))).alias("disk"), ((1 - now) - F.coalesce(1 - before.cast("long"), F.lit(0))).alias("memory"))
    parts = settled(change.withColumn("part", F.floor(F.col("n") / 10_000)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum("disk").alias("d"), F.sum("memory").alias("m"))
    offsets = totals.select("part", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("d"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m"))
    upto = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("own_d", F.sum("disk").over(upto)).withColumn("own_m", F.sum("memory").over(upto)).join(offsets, "part").select("n", (F.col("d") + F.col("own_d")).alias("on_disk"), (F.col("m") + F.col("own_m")).alias("in_memory"))


def flush_rate(events: DataFrame, order: str, file: str, interval: int, flushed: Column, dirty: Column) -> DataFrame:
    """(bucket, file, flush_dirty_rate): of a file's flushes in an interval the share that were dirty, in percent; 0 without flushes."""
    share = F.sum(F.when(flushed & dirty, 100.0).otherwise(0.0)) / F.nullif(F.count(F.when(flushed, 1)), F.lit(0))
    return intervals(events, order, file, interval, {"flush_dirty_rate": F.coalesce(rounded(share), F.lit(0.0))}).select("bucket", "file", "flush_dirty_rate")


def last_values(events: DataFrame, order: str, file: str, interval: int, value: Column) -> DataFrame:
    """(bucket, file, value): what a series, as of cache use, was at the file's last event of an interval."""
    return intervals(events, order, file, interval, {"value": F.max_by(value, order)}).select("bucket", "file", "value")


def counter(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
