"""Iteration over graphs: written steps, neighbours, label propagation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE

_OWN: dict[str, str] = {}
ROWS = 100_000  # in a file of a written step, and in a task of a spread table


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and read again: iterations neither recompute nor pile up plans."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tripleflow-graph-"))
    path = f"{root.rstrip('/')}/graph/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", ROWS).parquet(path)  # small files: however well terms compress, a task reads a bounded number of rows
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` over as many tasks as ``rows`` asks for: what a task holds doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // ROWS)), *keys)


def unsettle(*settled_: DataFrame) -> None:
    """Delete the files of tables that ``settled`` gave."""
    for df in settled_:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def neighbours(triples: DataFrame) -> DataFrame:
    """Undirected edges (a, b), both ways and once each, without loops and types."""
    one = triples.where((F.col("s") != F.col("o")) & (F.col("p") != RDF_TYPE) & ~F.startswith("o", F.lit('"'))).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def propagate(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, part): each node takes the commonest label among its neighbours, ties to the least, for some rounds."""
    edges = settled(edges)
    labels = settled(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("part")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        votes = edges.join(labels, edges["b"] == labels["node"]).groupBy("a", "part").agg(F.count(F.lit(1)).alias("n"))
        labels = settled(votes.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "part"))["part"].alias("part")))
    return labels
