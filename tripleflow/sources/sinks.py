"""What leaves the engine: query results, triples, N-Quads, edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import restore_blank


def decoded(result: DataFrame) -> DataFrame:
    """Blank nodes as they were read."""
    return result.select(*[restore_blank(F.col(f"`{c}`")).alias(c) for c in result.columns])


def write_tsv(result: DataFrame, path: str) -> None:
    """Tab-separated rows under a header of variable names; written by all tasks, a file each. An empty result has no header."""
    lines = decoded(result).select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in result.columns]).alias("value"))
    head = result.sparkSession.createDataFrame([("\t".join(result.columns),)], "value string")
    lines.write.mode("overwrite").text(f"{path}/rows")
    if not result.sparkSession.read.text(f"{path}/rows").isEmpty():
        head.coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_triples(triples: DataFrame, path: str) -> None:
    """Parquet by predicate: patterns that name one read its folder only."""
    # a common predicate is spread over tasks by its subjects
    triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(64))).write.mode("overwrite").partitionBy("p").parquet(path)


def write_cover(cover: DataFrame, path: str) -> None:
    cover.write.mode("overwrite").partitionBy("chunk").parquet(path)


def read_cover(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """What write_cover wrote, terms or ids: all chunks, or the folder of one."""
    df = spark.read.parquet(path)
    return df if chunk is None else df.where(F.col("chunk") == chunk)


def write_statistics(matrix: DataFrame, path: str) -> None:
    """CSV with a header: term, then its counts by chunk as subject, as property and as object (statistics.matrix)."""
    n = len(matrix.first()["row"]) // 3 if not matrix.isEmpty() else 0
    cells = [F.col("row")[k].alias(f"{'spo'[k // n]}{k % n}") for k in range(3 * n)]
    matrix.select("term", *cells).write.mode("overwrite").option("header", "true").csv(path)


def write_metrics(records: DataFrame, path: str) -> None:
    """Interval records as gzipped CSV with a header, a folder for each file of the log."""
    records.write.mode("overwrite").partitionBy("file").option("header", "true").option("compression", "gzip").csv(path)


def write_measurements(measurements: DataFrame, path: str) -> None:
    """(server, message_number, ts, type, values) as gzipped tab-separated lines, values one after the other."""
    fields = [F.col(c).cast("string") for c in ("server", "message_number", "ts", "type")]
    line = F.concat_ws("\t", *fields, F.array_join("values", "\t"))
    measurements.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_nquads(triples: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", restore_blank(F.col("s")), F.col("p"), restore_blank(F.col("o")), F.lit("."))
    triples.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def dot_edges(cover: DataFrame) -> DataFrame:
    """Lines of a DOT digraph, an edge for each placed triple, coloured by chunk."""
    quoted = lambda c: F.replace(F.col(c), F.lit('"'), F.lit('\\"'))
    edge = F.format_string('  "%s" -> "%s" [label="%s", colorscheme=set312, color=%d];', quoted("s"), quoted("o"), quoted("p"), F.col("chunk") % 12 + 1)
    return cover.select(edge.alias("line"))
