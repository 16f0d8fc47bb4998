"""Time-varying curriculum: weight schedules, integrated demand, inverted positions.

Only DataFrame functions. A source's prefix sums are split over hash buckets of
its documents, so a source with a third of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1000
MAX_BUCKETS = 1 << 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Word targets per source by water-filling.

    ``sizes`` holds source, source_size, n_rows (one row per source). Weights repeat
    over the sources by code point, null last. Every target is min(cap * size, level *
    weight); giving the excess over a cap to the others by weight ends in just that
    level, found here from prefix sums over the sources in the order in which they
    reach their caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", pick)
        .withColumn("limit", F.col("source_size") * F.lit(cap))
        .withColumn("fills_at", F.col("limit") / F.col("weight"))
    )
    whole = Window.partitionBy()
    filled = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("limit").over(filled), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))),
    )
    # the level holds once the next source to fill does not reach its cap by it
    settled = levels.withColumn("final", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(whole)["level"])
    return settled.select(
        "source", "rank", "weight", "source_size", "n_rows",
        F.coalesce(F.least(F.col("limit"), F.col("final") * F.col("weight")), F.col("limit")).alias("target"),
    )


def order_key(row_id: Column) -> Column:
    """A number in [0, 1) from the id's text: the fixed random order of a source."""
    head = F.substring(F.md5(F.coalesce(row_id.cast("string"), F.lit(""))), 1, 10)
    return F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 40))


def slope(weight: Column, weights: tuple[int, ...]) -> Column:
    """Schedules are linear: the heaviest sources fade out by ``-0.8`` and the lightest fade in by ``+0.8``."""
    top, low = float(max(weights)), float(min(weights))
    return F.lit(0.8) - (weight - low) * (1.6 / (top - low)) if top > low else F.lit(0.0)


def mix_curriculum(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id") -> DataFrame:
    """Words taken from each document and the training time at which it is first read.

    A source s has weight w_s(t) = 1 + a_s (2t - 1) over training time t in [0, 1];
    its integral (1 - a) t + a t^2 times its target is the words demanded by time t.
    The source's documents, in a fixed random order and repeated in passes, form a
    word stream; inverting the integral at a document's offset gives its position.
    The document at the end of the stream is cut so that a source takes its target to
    the word. Null or wordless texts take 0; a null source is a source of its own, the
    last; repeated rows count each time; an empty table gives an empty result. Extra
    columns of ``docs`` are not carried. Returns id, source, size, source_size,
    target, taken, passes, position (null where nothing is taken).
    """
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            order_key(F.col(id_col)).alias("u"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = stage(source_targets(sources, weights, share, cap), "mix-targets").withColumn(
        "buckets", F.least(F.ceil(F.col("n_rows") / BUCKET_ROWS), F.lit(MAX_BUCKETS))
    )
    rows = sized.join(targets.withColumnRenamed("source", "named"), sized["source"].eqNullSafe(F.col("named"))).withColumn(
        "bucket", F.floor(F.col("u") * F.col("buckets"))
    )
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("rank").alias("o_rank"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("rank", "bucket").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    placed = local.join(offsets, (F.col("rank") == F.col("o_rank")) & (F.col("bucket") == F.col("o_bucket")))
    want = F.round("target").cast("long")
    start = F.col("offset") + F.col("inside")
    full = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0)
    rest = want - full * F.col("source_size")
    last = F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    a = slope(F.col("weight"), weights)
    done = F.when(want > 0, start / want)
    # t solves a t^2 + (1 - a) t = done
    invert = F.when(F.abs(a) < 1e-9, done).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * done) - (1 - a)) / (2 * a))
    return placed.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        (full * F.col("size") + last).cast("long").alias("taken"),
        (full + F.when(last * 2 >= F.col("size"), 1).otherwise(0)).cast("int").alias("passes"),
        F.when(full * F.col("size") + last > 0, invert + 0.0).alias("position"),
    )


def in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Range-sort by position: the files, read in order, are the curriculum; what is not taken comes last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), id_col)
