"""Turtle files as triples: a file is parsed by one task, as its prefixes hold to its end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import BLANK, RDF_TYPE
from ..plans.algebra import QuerySyntaxError, Term, TriplePattern, UnsupportedFeature, Var
from ..plans.parser import _Parser

_RDF = RDF_TYPE[1:-5]
NAMES = "*.{ttl,n3,ttl.gz,n3.gz}"


class _Turtle(_Parser):
    """Statements end with a full stop; blank nodes are IRIs of their own, known within a file."""

    def __init__(self, text: str, scope: str):
        super().__init__(text)
        self.scope = scope

    def node(self, term: Term) -> str:
        return f"<{BLANK[1:]}{self.scope}{term.name}>" if isinstance(term, Var) else term

    def statements(self) -> Iterator[tuple[str, str, str]]:
        while self.peek()[0] != "end":
            if self.peek()[0] == "lang" and self.peek()[1].lower() in ("@prefix", "@base"):
                self.tokens[self.at] = ("word", self.peek()[1][1:])
                self.directive()
                self.expect(".")
            elif self.word() in ("PREFIX", "BASE"):
                self.directive()
            else:
                found: list[TriplePattern] = []
                self.triples(found)
                self.expect(".")
                yield from ((self.node(t.s), self.node(t.p), self.node(t.o)) for t in found)

    def directive(self) -> None:
        """One at a time, as a full stop may follow."""
        rest, self.tokens = self.tokens, self.tokens[: self.at + (2 if self.word() == "BASE" else 3)]
        try:
            self.prologue()
        finally:
            self.tokens = rest

    def fresh(self) -> Var:
        self.hidden += 1
        return Var(f"-{self.hidden}")

    def term(self, out: list[TriplePattern], place: str) -> Term:
        kind, text = self.peek()
        if kind == "var":
            raise QuerySyntaxError(f"{text!r} is no {place}")
        if text == "(":
            self.take()
            items = []
            while self.peek()[1] != ")":
                items.append(self.term(out, "object"))
            self.take()
            rest: Term = f"<{_RDF}nil>"
            for item in reversed(items):
                cell = self.fresh()
                out += [TriplePattern(cell, f"<{_RDF}first>", item), TriplePattern(cell, f"<{_RDF}rest>", rest)]
                rest = cell
            return rest
        return super().term(out, place)


def parse_turtle(text: str, scope: str = "") -> tuple[list[tuple[str, str, str]], str | None]:
    """Triples up to the first error, and the error."""
    out: list[tuple[str, str, str]] = []
    try:
        for t in _Turtle(text, scope).statements():
            out.append(t)
    except (QuerySyntaxError, UnsupportedFeature) as e:
        return out, str(e) or type(e).__name__
    return out, None


def read_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(statements with duplicates, files with an error and what it is) of a Turtle file or a folder of them."""
    reader = spark.read
    single = any(path.endswith(x) for x in (".ttl", ".n3", ".ttl.gz", ".n3.gz"))
    files = (reader if single else reader.option("pathGlobFilter", NAMES)).text(path, wholetext=True).select("value", F.input_file_name().alias("file"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, error = parse_turtle(text, hashlib.md5(file.encode()).hexdigest()[:12])
                rows = [(*t, None) for t in found] + ([(None, None, None, f"{file}: {error}")] if error else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, names=["s", "p", "o", "line"])

    parsed = files.mapInArrow(parse, "s string, p string, o string, line string")
    return parsed.where("s is not null").select("s", "p", "o"), parsed.where("line is not null").select("line")
