"""Relational tables as a graph, without materialising it.

Row of table t with key k: subject <urn:t/k>; a column c gives predicate <urn:c> and,
for a foreign key, the IRI of the row it refers to, else a literal; each row has an
rdf:type. A pattern that names its predicate reads one column of one table, one that
names its subject one row of one table: the predicate or the key is turned into a
choice of branches and a pushed filter before Spark sees the plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, iri, literal


@dataclass(frozen=True)
class Mapping:
    """A table, its key, its columns, and what foreign keys refer to."""

    table: str
    key: tuple[str, ...]
    columns: tuple[str, ...]
    refers: dict[str, str] = field(default_factory=dict)
    subject: str | None = None

    @property
    def home(self) -> str:
        return self.subject or self.table


MAPPINGS = {
    m.table: m
    for m in (
        Mapping("region", ("r_regionkey",), ("r_name",)),
        Mapping("nation", ("n_nationkey",), ("n_name", "n_regionkey"), {"n_regionkey": "region"}),
        Mapping("customer", ("c_custkey",), ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), {"c_nationkey": "nation"}),
        Mapping("supplier", ("s_suppkey",), ("s_name", "s_nationkey", "s_acctbal"), {"s_nationkey": "nation"}),
        Mapping("part", ("p_partkey",), ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        Mapping("orders", ("o_orderkey",), ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), {"o_custkey": "customer"}),
        Mapping(
            "lineitem",
            ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
            ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
            {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
        ),
        Mapping("events", ("event_id",), ("ts", "user_id", "event_type", "value"), {"user_id": "user"}),
        Mapping("documents", ("doc_id",), ("lang", "source", "n_chars")),
        Mapping("labels", ("doc_id",), ("quality", "toxic"), subject="documents"),
    )
}


class StoredGraph:
    """A DataFrame of distinct (s, p, o)."""

    def __init__(self, triples: DataFrame):
        self.triples = triples

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        df = self.triples.select("s", "p", "o")
        for name, value in (("s", s), ("p", p), ("o", o)):
            if value is not None:
                df = df.where(F.col(name) == value)
        return df


class TableGraph:
    """Parquet tables seen as triples; keys are unique, so no triple comes twice and no distinct is needed."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: list[str]):
        self.spark, self.sf_dir, self.tables = spark, sf_dir, tables

    def _subject(self, m: Mapping) -> Column:
        return iri(f"urn:{m.home}/", *[F.col(k) for k in m.key])

    def _object(self, m: Mapping, column: str) -> Column:
        return iri(f"urn:{m.refers[column]}/", F.col(column)) if column in m.refers else literal(F.col(column))

    def _with_object(self, rows: DataFrame, m: Mapping, column: str, o: str) -> DataFrame:
        """``rows`` by a filter on the stored column, which reaches the scan; the term itself is compared later on."""
        kind = rows.schema[column].dataType.typeName()
        if column in m.refers and kind in ("integer", "long") and (k := re.fullmatch(rf"<urn:{m.refers[column]}/(-?\d{{1,18}})>", o)):
            return rows.where(F.col(column) == int(k[1]))
        if column not in m.refers and kind == "string" and len(o) >= 2 and o[0] == o[-1] == '"' and "\\" not in o:
            return rows.where(F.col(column) == o[1:-1])
        return rows

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        parts = []
        for name in self.tables:
            m = MAPPINGS[name]
            if s is not None and not s.startswith(f"<urn:{m.home}/"):
                continue
            rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if s is not None and len(m.key) == 1 and (k := re.fullmatch(r"<urn:[^/]*/(-?\d{1,18})>", s)):
                rows = rows.where(F.col(m.key[0]) == int(k[1]))
            wanted = [c for c in m.columns if p is None or p == f"<urn:{c}>"]
            if o is not None and p is not None and len(wanted) == 1:
                rows = self._with_object(rows, m, wanted[0], o)
            pairs = [F.struct(F.lit(f"<urn:{c}>").alias("p"), self._object(m, c).alias("o")) for c in wanted]
            if p is None or p == RDF_TYPE:
                pairs.append(F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(f"<urn:{m.home}>").alias("o")))
            if len(pairs) == 1:
                parts.append(rows.select(self._subject(m).alias("s"), pairs[0]["p"].alias("p"), pairs[0]["o"].alias("o")))
            elif pairs:
                parts.append(rows.select(self._subject(m).alias("s"), F.explode(F.array(*pairs)).alias("t")).select("s", "t.p", "t.o"))
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string")
        df = parts[0]
        for x in parts[1:]:
            df = df.unionAll(x)
        df = df.where(F.col("o").isNotNull())
        for name, value in (("s", s), ("p", p), ("o", o)):
            if value is not None:
                df = df.where(F.col(name) == value)
        return df

    @property
    def triples(self) -> DataFrame:
        return self.scan()


def triples_sql(tables: list[str]) -> str:
    """The same triples as SQL over the same tables."""
    out = []
    for name in tables:
        m = MAPPINGS[name]
        subject = f"'<urn:{m.home}/' || concat_ws('-', {', '.join(f'CAST({k} AS VARCHAR)' for k in m.key)}) || '>'"
        for c in m.columns:
            obj = f"'<urn:{m.refers[c]}/' || CAST({c} AS VARCHAR) || '>'" if c in m.refers else f"'\"' || CAST({c} AS VARCHAR) || '\"'"
            out.append(f"SELECT {subject} AS s, '<urn:{c}>' AS p, {obj} AS o FROM {name} WHERE {c} IS NOT NULL")
        out.append(f"SELECT {subject} AS s, '{RDF_TYPE}' AS p, '<urn:{m.home}>' AS o FROM {name}")
    return " UNION ALL ".join(out)
