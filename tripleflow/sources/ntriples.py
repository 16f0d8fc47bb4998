"""N-Triples and N-Quads files as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import skolemise

_NODE = r"(<[^<>\"{}|^`\\\x00-\x20]*>|_:[^\s<>\"]+)"
_OBJECT = r"(<[^<>\"{}|^`\\\x00-\x20]*>|_:[^\s<>\"]+|\"(?:[^\"\\\n\r]|\\.)*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?)"
_LINE = rf"^\s*{_NODE}\s*(<[^<>\s]*>)\s*{_OBJECT}\s*(<[^<>\s]*>|_:[^\s<>\"]+)?\s*\.\s*(?:#.*)?$"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with s, p, o (null where a line is no statement); a graph name is read and dropped."""
    line = F.col(column)
    ok = F.rlike(line, F.lit(_LINE))
    part = lambda k: F.when(ok, F.regexp_extract(line, _LINE, k))
    return lines.select(line.alias("line"), skolemise(part(1)).alias("s"), part(2).alias("p"), skolemise(part(3)).alias("o"))


def read_statements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(statements with duplicates, rejected lines) of a file or folder of .nt, .nq, .ttl, .n3 and their .gz; other files are passed over.

    A Turtle file gives its statements up to the first error, and the error as a rejected line.
    """
    from .turtle import read_turtle

    if any(path.endswith(x) for x in (".ttl", ".n3", ".ttl.gz", ".n3.gz")):
        return read_turtle(spark, path)
    reader = spark.read.option("recursiveFileLookup", "false")
    single = any(path.endswith(x) for x in (".nt", ".nq", ".nt.gz", ".nq.gz"))
    lines = reader.text(path) if single else reader.option("pathGlobFilter", "*.{nt,nq,nt.gz,nq.gz}").text(path)
    parsed = parse_lines(lines)
    statements, rejected = parsed.where(F.col("s").isNotNull()).select("s", "p", "o"), parsed.where(F.col("s").isNull() & ~F.rlike("line", F.lit(r"^\s*(#.*)?$"))).select("line")
    if single:
        return statements, rejected
    more, errors = read_turtle(spark, path)
    return statements.unionAll(more), rejected.unionAll(errors)


def first_triples(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` statements in the order of the files' lines, duplicates included."""
    return read_statements(spark, path)[0].limit(n)


def clean(spark: SparkSession, path: str, out: str) -> None:
    """Statements that hold, written anew as gzipped N-Quads; malformed lines go."""
    from .sinks import write_nquads

    write_nquads(read_statements(spark, path)[0], out)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """The set of triples; malformed lines are skipped."""
    return read_statements(spark, path)[0].distinct()
