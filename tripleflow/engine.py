"""The engine: load graphs, place them, query them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import covers, statistics
from .operators.graph import settled, unsettle
from .plans.algebra import show
from .plans.parser import parse
from .plans.planner import compile_plan
from .sources.ntriples import read_triples
from .sources.sinks import decoded, write_tsv
from .sources.tables import StoredGraph, TableGraph


@dataclass
class Loaded:
    """What a load with a cover leaves."""

    cover: DataFrame
    stats: DataFrame
    sizes: DataFrame
    owners: DataFrame


class Engine:
    """A load replaces what was there. Answers never depend on the cover: queries run over the set of triples."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graph: StoredGraph | TableGraph | None = None
        self.loaded: Loaded | None = None

    def load_files(self, path: str, strategy: str = "HASH", chunks: int = 4, hops: int = 0, **options) -> Loaded:
        return self.load(read_triples(self.spark, path), strategy, chunks, hops, **options)

    def load(self, triples: DataFrame, strategy: str = "HASH", chunks: int = 4, hops: int = 0, **options) -> Loaded:
        if strategy not in covers.STRATEGIES:
            raise ValueError(f"unknown cover {strategy}; there are {', '.join(covers.STRATEGIES)}")
        triples = settled(triples.select("s", "p", "o").distinct())
        self.graph = StoredGraph(triples)
        cover = settled(covers.n_hop(covers.STRATEGIES[strategy](triples, chunks, **options), hops))
        stats = settled(statistics.frequencies(cover))
        self.loaded = Loaded(cover, stats, statistics.chunk_sizes(cover), statistics.owners(stats))
        return self.loaded

    def load_tables(self, sf_dir: str, tables: list[str]) -> None:
        """Tables as they are: nothing is copied."""
        self.graph, self.loaded = TableGraph(self.spark, sf_dir, tables), None

    def query(self, text: str, tree: str = "LEFT_LINEAR", single: bool = False) -> DataFrame:
        if self.graph is None:
            raise ValueError("nothing is loaded")
        return decoded(compile_plan(self.graph, parse(text), tree, single))

    def query_file(self, path: str, **options) -> DataFrame:
        text = "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())
        return self.query(text, **options)

    def explain(self, text: str, tree: str = "LEFT_LINEAR") -> str:
        return show(parse(text), tree)

    def estimate(self, text: str, tree: str = "LEFT_LINEAR") -> DataFrame:
        if self.loaded is None:
            raise ValueError("estimates need a loaded cover")
        return statistics.estimate(parse(text), self.loaded.stats, self.loaded.sizes, tree)

    def run(self, text: str, path: str, **options) -> tuple[int, float]:
        """Write the answer to ``path``; its number of rows and the seconds taken."""
        began = time.perf_counter()
        write_tsv(self.query(text, **options), path)
        return self.spark.read.text(f"{path}/rows").count(), time.perf_counter() - began

    def drop(self) -> None:
        """Forget what was loaded, and delete what was stored for it."""
        if self.loaded:
            unsettle(self.graph.triples, self.loaded.cover, self.loaded.stats)
        self.graph = self.loaded = None
