"""Frequencies of resources by chunk and role, owners, and cardinality estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import Bgp, Plan, Project, Slice, TriplePattern, Var, shape


def frequencies(cover: DataFrame) -> DataFrame:
    """(term, chunk, sf, pf, of): how often a term is subject, property and object in a chunk; copies count."""
    role = cover.select("chunk", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("term")) for r in "spo"])).alias("x"))
    count = lambda r: F.count(F.when(F.col("x.role") == r, 1))
    return role.groupBy(F.col("x.term").alias("term"), "chunk").agg(count("s").alias("sf"), count("p").alias("pf"), count("o").alias("of"))


def chunk_sizes(cover: DataFrame) -> DataFrame:
    return cover.groupBy("chunk").agg(F.count(F.lit(1)).alias("triples"))


def totals(stats: DataFrame) -> DataFrame:
    """Frequencies over all chunks."""
    return stats.groupBy("term").agg(F.sum("sf").alias("sf"), F.sum("pf").alias("pf"), F.sum("of").alias("of"))


def matrix(stats: DataFrame, chunks: int) -> DataFrame:
    """(term, row): the subject counts of all chunks, then property, then object counts."""
    cells = [F.sum(F.when(F.col("chunk") == c, F.col(r)).otherwise(0)) for r in ("sf", "pf", "of") for c in range(chunks)]
    return stats.groupBy("term").agg(F.array(*cells).alias("row"))


def owners(stats: DataFrame) -> DataFrame:
    """(term, owner): the chunk with most uses as subject, then object, then property, then the lowest."""
    return stats.groupBy("term").agg(F.max_by("chunk", F.struct("sf", "of", "pf", (-F.col("chunk")).alias("c"))).alias("owner"))


def _frequency(stats: DataFrame, pattern: TriplePattern, chunk: Column) -> DataFrame:
    """(chunk, size of each constant): a row for each chunk."""
    role = {"s": "sf", "p": "pf", "o": "of"}
    terms = [(r, t) for r, t in zip("spo", (pattern.s, pattern.p, pattern.o), strict=True) if not isinstance(t, Var)]
    out = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col(role[r]))), F.lit(0)).alias(r) for r, t in terms]
    wanted = stats.where(F.col("term").isin([t for _, t in terms]) if terms else F.lit(False))
    return wanted.groupBy("chunk").agg(*out) if out else wanted.select("chunk").distinct()


def estimate(plan: Plan | TriplePattern | tuple, stats: DataFrame, sizes: DataFrame, tree: str = "LEFT_LINEAR") -> DataFrame:
    """(chunk, load): what a plan is taken to give in each chunk.

    No constant: the chunk's size; one: its frequency; two: the smaller; three: 1 if all
    are there, else 0. A join: the product of both totals, spread evenly; others as
    their input.
    """
    if isinstance(plan, (Project, Slice)):
        return estimate(plan.child, stats, sizes, tree)
    if isinstance(plan, Bgp):
        return estimate(shape(plan.patterns, tree), stats, sizes, tree)
    if isinstance(plan, TriplePattern):
        base = sizes.join(_frequency(stats, plan, F.col("chunk")), "chunk", "left")
        roles = [r for r, t in zip("spo", (plan.s, plan.p, plan.o), strict=True) if not isinstance(t, Var)]
        f = [F.coalesce(F.col(r), F.lit(0)) for r in roles]
        if not f:
            load = F.col("triples")
        elif len(f) == 1:
            load = f[0]
        elif len(f) == 2:
            load = F.least(*f)
        else:
            load = F.when(F.least(*f) > 0, 1).otherwise(0)
        return base.select("chunk", load.cast("double").alias("load"))
    left, right = (estimate(x, stats, sizes, tree).agg(F.sum("load").alias(n)) for x, n in zip(plan, "lr", strict=True))
    both = left.join(right, F.lit(True)).join(sizes.agg(F.count(F.lit(1)).alias("n")), F.lit(True))  # a row each
    return sizes.select("chunk").join(F.broadcast(both), F.lit(True)).select("chunk", (F.col("l") * F.col("r") / F.col("n")).alias("load"))
