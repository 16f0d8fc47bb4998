"""Graph covers: which chunk each triple is placed in. Every strategy adds a ``chunk`` column to (s, p, o)."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import BLANK, RDF_TYPE, fold_hash, hash_chunk, iri_parts
from .graph import neighbours, propagate, settled, spread

OVER = 187  # fixed value: of the number of partitions
PACKED = 4096  # the largest partitions that are packed one by one; smaller ones are hashed


def hash_cover(triples: DataFrame, chunks: int) -> DataFrame:
    """By subject."""
    return triples.withColumn("chunk", hash_chunk(F.col("s"), chunks))


def vertical_cover(triples: DataFrame, chunks: int) -> DataFrame:
    """By property."""
    return triples.withColumn("chunk", hash_chunk(F.col("p"), chunks))


def hierarchical_cover(triples: DataFrame, chunks: int, levels: int | None = None) -> DataFrame:
    """By the first parts of the subject IRI, as many as give the least deviation of chunk sizes.

    All levels up to the deepest IRI's, or up to ``levels``, are tried in one
    aggregation; the first wins on ties. An IRI with fewer parts has all of them; blank
    nodes go by their own hash.
    """
    name = lambda parts, n: F.when(F.startswith("s", F.lit(BLANK)), F.col("s")).otherwise(F.concat(F.lit("//"), F.array_join(F.slice(parts, 1, n), "/")))
    tried = triples.groupBy("s").agg(F.count(F.lit(1)).alias("n")).select("s", "n", iri_parts(F.col("s")).alias("parts"))
    own = F.greatest(F.lit(1), F.size("parts"))
    own = own if levels is None else F.least(F.lit(max(1, levels)), own)
    each = tried.select("s", "n", "parts", F.explode(F.sequence(F.lit(1), F.when(F.startswith("s", F.lit(BLANK)), 1).otherwise(own))).alias("level"))
    placed = each.select("n", "level", ((F.col("level") == own) | F.startswith("s", F.lit(BLANK))).alias("last"), hash_chunk(name(F.col("parts"), F.col("level")), chunks).alias("chunk"))
    deeper, whole = defaultdict(Counter), defaultdict(Counter)  # by level; whole: of subjects that have no more levels
    for r in placed.groupBy("level", "last", "chunk").agg(F.sum("n").alias("n")).collect():
        (whole if r["last"] else deeper)[r["level"]][r["chunk"]] += r["n"]
    best, least, done = 1, None, Counter()
    for k in range(1, max([1, *deeper, *whole]) + 1):
        done += whole[k]
        spread = sum(n * n for n in (done + deeper[k]).values())  # the total is that of all levels, so this ranks deviations
        if least is None or spread < least:
            best, least = k, spread
    return triples.withColumn("chunk", hash_chunk(name(iri_parts(F.col("s")), best), chunks))


def pack(sizes: list[tuple[str, int]], chunks: int) -> dict[str, int]:
    """Largest first, each into the smallest chunk, the lowest number on ties."""
    heap = [(0, c) for c in range(chunks)]
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, c = heapq.heappop(heap)
        out[name] = c
        heapq.heappush(heap, (held + n, c))
    return out


def packed_chunks(sizes: DataFrame, chunks: int) -> DataFrame:
    """(part, chunk) for (part, n): the PACKED largest by greedy packing on the driver, the many small ones by hash."""
    large = [(r["part"], r["n"]) for r in sizes.orderBy(F.desc("n"), "part").limit(PACKED).collect()]
    table = sizes.sparkSession.createDataFrame([(k, v) for k, v in pack(large, chunks).items()], "big string, packed int")
    return sizes.join(F.broadcast(table), F.col("part") == F.col("big"), "left").select("part", F.coalesce("packed", F.abs(fold_hash(F.col("part")) % chunks)).alias("chunk"))


def min_edge_cut_cover(triples: DataFrame, chunks: int, partitioner: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Triples go with the partition of their subject.

    ``partitioner`` maps undirected edges (a, b) without loops and rdf:type to (node,
    part); by default labels spread over a few rounds. Subjects that it does not know
    are in chunk 0.
    """
    parts = settled((partitioner or propagate)(neighbours(triples)).select("node", F.col("part").cast("string").alias("part")))
    homes = packed_chunks(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")), chunks)
    known = parts.join(homes, "part").select("node", "chunk")
    return triples.join(known, triples["s"] == known["node"], "left").select("s", "p", "o", F.coalesce("chunk", F.lit(0)).cast("int").alias("chunk"))


def over_partitioned_cover(triples: DataFrame, chunks: int, partitioner: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """More partitions than chunks, packed by their number of triples; unknown subjects are partitions of their own.

    There are ceil(sqrt(187 * vertices / chunks)) partitions at most: what the
    partitioner gives is packed into as many by vertices first.
    """
    parts = settled((partitioner or propagate)(neighbours(triples)).select("node", F.col("part").cast("string").alias("part")))
    many = math.ceil(math.sqrt(OVER * max(1, parts.count()) / chunks))
    groups = packed_chunks(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")), many)
    parts = parts.join(groups, "part").select("node", F.col("chunk").cast("string").alias("part"))
    placed = settled(triples.join(parts, triples["s"] == parts["node"], "left").select("s", "p", "o", F.coalesce("part", "s").alias("part")))
    homes = packed_chunks(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), chunks)
    return placed.join(homes, "part").select("s", "p", "o", F.col("chunk").cast("int").alias("chunk"))


def edge_coloring_cover(triples: DataFrame, chunks: int, slack: float = 0.05) -> DataFrame:
    """Edges that meet in a vertex share a colour as long as it holds ``slack`` of a chunk at most; colours are packed.

    All edges out of a subject have one colour. A subject joins the vertex of least
    degree among itself and its objects, ties by name; the subjects that join a vertex
    are cut in order into colours of the allowed size. Each step is an aggregation, where
    a walk over all vertices in turn would be sequential.
    """
    total = triples.count()
    most = max(1.0, total // chunks * slack)
    ends = triples.select(F.explode(F.array("s", "o")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    outs = triples.groupBy("s").agg(F.count(F.lit(1)).alias("out"))
    near = triples.join(ends, triples["o"] == ends["v"]).groupBy("s").agg(F.min(F.struct("degree", F.col("v").alias("name"))).alias("m"))
    own = outs.join(ends.withColumnRenamed("degree", "d"), outs["s"] == F.col("v")).join(near, "s")
    chosen = own.select("s", "out", F.least(F.struct(F.col("d").alias("degree"), F.col("s").alias("name")), F.col("m"))["name"].alias("vertex"))
    # running sizes within a vertex: hot vertices are cut by a hash of the subject first
    wide = chosen.groupBy("vertex").agg(F.sum("out").alias("all"))
    salted = chosen.join(wide, "vertex").withColumn("salt", F.pmod(fold_hash(F.col("s")), F.greatest(F.lit(1), F.ceil(F.col("all") / (F.lit(most) * 8))).cast("int")))
    running = F.sum("out").over(Window.partitionBy("vertex", "salt").orderBy("s"))
    coloured = settled(salted.withColumn("color", F.concat_ws("|", "vertex", "salt", F.floor((running - F.col("out")) / most).cast("string"))).select("s", "out", "color"))
    homes = packed_chunks(coloured.groupBy(F.col("color").alias("part")).agg(F.sum("out").alias("n")), chunks)
    known = coloured.join(homes, F.col("color") == F.col("part")).select(F.col("s").alias("subject"), "chunk")
    return triples.join(known, triples["s"] == known["subject"]).select("s", "p", "o", F.col("chunk").cast("int").alias("chunk"))


def molecule_cover(triples: DataFrame, chunks: int, diameter: int = 2) -> DataFrame:
    """Molecules (all triples of a subject) join the chunk of the molecule that reaches them first.

    Seeds are subjects that no triple points to, placed by hash. Each round extends the
    frontier along outgoing edges; a molecule reached at the greatest diameter is placed
    by its own hash and starts anew. Ties go to the lowest chunk. When the frontier is
    empty, the least unplaced subject of the rest by hash fraction becomes a seed: all
    subjects left with no unplaced predecessor of smaller name.
    """
    edges = settled(triples.select("s", "o").where("s <> o").distinct())
    subjects = settled(triples.select("s").distinct())
    inner = edges.join(subjects.withColumnRenamed("s", "t"), F.col("o") == F.col("t")).select("s", "o")
    inner = settled(inner)
    placed = settled(subjects.join(inner.select(F.col("o").alias("s")).distinct(), "s", "left_anti").select("s", hash_chunk(F.col("s"), chunks).alias("chunk"), F.lit(0).alias("depth")))
    frontier = placed
    while True:
        step = frontier.join(inner, "s").groupBy("o").agg(F.min(F.struct("chunk", "depth")).alias("f"))
        fresh = step.join(placed.select(F.col("s").alias("o")), "o", "left_anti")
        far = F.col("f.depth") + 1 >= diameter
        frontier = settled(fresh.select(F.col("o").alias("s"), F.when(far, hash_chunk(F.col("o"), chunks)).otherwise(F.col("f.chunk")).alias("chunk"), F.when(far, 0).otherwise(F.col("f.depth") + 1).alias("depth")))
        if frontier.isEmpty():
            rest = subjects.join(placed, "s", "left_anti")
            # of a cycle, those without an unplaced predecessor of smaller name
            held = inner.join(rest.withColumnRenamed("s", "r"), F.col("s") == F.col("r")).where("s < o").select(F.col("o").alias("s")).distinct()
            frontier = settled(rest.join(held, "s", "left_anti").select("s", hash_chunk(F.col("s"), chunks).alias("chunk"), F.lit(0).alias("depth")))
            if frontier.isEmpty():
                break
        placed = settled(placed.unionAll(frontier))
    known = placed.select(F.col("s").alias("subject"), "chunk")
    return triples.join(known, triples["s"] == known["subject"]).select("s", "p", "o", F.col("chunk").cast("int").alias("chunk"))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "HASH": hash_cover,
    "VERTICAL": vertical_cover,
    "HIERARCHICAL": hierarchical_cover,
    "MIN_EDGE_CUT": min_edge_cut_cover,
    "MEC_OVER": over_partitioned_cover,
    "EDGE_COLORING": edge_coloring_cover,
    "MOLECULE_HASH": molecule_cover,
}


def register(name: str, strategy: Callable[..., DataFrame]) -> None:
    """Add a placement strategy of one's own."""
    STRATEGIES[name] = strategy


def n_hop(cover: DataFrame, hops: int) -> DataFrame:
    """Chunks extended by the triples of all subjects within ``hops`` steps of theirs; (s, p, o, chunk), copies in several chunks."""
    if hops == 0:
        return cover
    triples = settled(cover.select("s", "p", "o"))
    rows = triples.count()
    held = settled(spread(cover.select("s", "chunk"), rows, "s").distinct())
    subjects = spread(triples.select(F.col("s").alias("known")), rows, "known").distinct()
    links = triples.where(~F.startswith("o", F.lit('"'))).select("s", "o")  # a literal is no subject
    for _ in range(hops):
        reached = spread(held, rows, "s").join(spread(links, rows, "s"), "s").select(F.col("o").alias("s"), "chunk").distinct()
        held = settled(spread(held.unionAll(reached.join(subjects, F.col("s") == F.col("known"), "left_semi")), rows, "s").distinct())
    return spread(held, rows, "s").join(spread(triples, rows, "s"), "s").select("s", "p", "o", "chunk")


def containment(cover: DataFrame) -> DataFrame:
    """Each triple once with the sorted list of chunks that hold it."""
    return cover.groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("chunk")).alias("containment"))
