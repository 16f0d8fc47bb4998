"""Plans to DataFrames. Order and shape of joins are as written, but what adds no rows is joined before what multiplies them; how joins run is Spark's choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import settled
from .algebra import Bgp, Plan, Project, Slice, TriplePattern, Var, shape

PIECE = 1_000_000  # rows that one key may give in one piece of a join
SALTS = 64  # pieces of a key, at most


def match(graph, pattern: TriplePattern) -> DataFrame:
    """Solutions of one pattern: a column for each variable, in the order of their places.

    A variable that comes twice must have equal values. A pattern without variables
    gives one row without columns if the triple is there.
    """
    terms = {"s": pattern.s, "p": pattern.p, "o": pattern.o}
    df = graph.scan(**{k: t for k, t in terms.items() if not isinstance(t, Var)})
    first: dict[str, str] = {}
    for place, t in terms.items():
        if isinstance(t, Var):
            if t.name in first:
                df = df.where(F.col(first[t.name]) == F.col(place))
            else:
                first[t.name] = place
    if not first:
        return df.limit(1).select()
    return df.select(*[F.col(place).alias(name) for name, place in first.items()])


def gate(rows: DataFrame, condition: DataFrame) -> DataFrame:
    """``rows`` if ``condition`` has any row, else none: a semi join with one row at most."""
    return rows.join(F.broadcast(condition.limit(1)), F.lit(True), "left_semi")


def join(left: DataFrame, right: DataFrame, many: bool = False) -> DataFrame:
    """Equi-join on all shared variables; existence gate where a side has none; else the product.

    ``many``: both sides may have many rows for a value; frequent values are then cut into pieces.
    """
    if not left.columns:
        return gate(right, left)
    if not right.columns:
        return gate(left, right)
    shared = [c for c in left.columns if c in right.columns]
    names = left.columns + [c for c in right.columns if c not in shared]
    if not shared:
        return left.crossJoin(right)
    if many:
        left, right = in_pieces(left, right, shared)
        shared = [*shared, "#piece"]
    right = right.select(*[F.col(f"`{c}`").alias(f"{c}#" if c in shared else c) for c in right.columns])
    on = None
    for c in shared:
        same = F.col(f"`{c}`") == F.col(f"`{c}#`")
        on = same if on is None else on & same
    return left.join(right, on).select(*[F.col(f"`{c}`") for c in names])


def in_pieces(left: DataFrame, right: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``#piece``, by hash of values and pieces: few values or small inputs don't leave a large result to few tasks.

    Of a value that gives more than PIECE rows, the larger side is dealt over the pieces and the smaller one copied to each.
    """
    spark = left.sparkSession
    columns = lambda df: [F.col(f"`{c}`") for c in df.columns]
    counted = lambda df, name: df.groupBy(*[F.col(f"`{c}`") for c in shared]).agg(F.count(F.lit(1)).alias(name))
    both = counted(left, "#l").join(counted(right, "#r"), shared).withColumn("#all", F.col("#l").cast("double") * F.col("#r"))
    heavy = both.where(F.col("#all") > PIECE).select(
        *[F.col(f"`{c}`").alias(f"{c}##") for c in shared], F.least(F.lit(SALTS), F.ceil(F.col("#all") / PIECE)).cast("int").alias("#salts"), (F.col("#l") >= F.col("#r")).alias("#deal")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def cut(df: DataFrame, deals: bool) -> DataFrame:
        on = [F.col(f"`{c}`") == F.col(f"`{c}##`") for c in shared]
        salts, dealt = F.coalesce("#salts", F.lit(1)), F.col("#deal") if deals else ~F.col("#deal")
        piece = F.when(dealt, F.array(F.pmod(F.xxhash64(*columns(df)), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
        out = df.join(F.broadcast(heavy), on, "left").select(*columns(df), F.explode(piece).alias("#piece"))
        return out.repartition(tasks, *[F.col(f"`{c}`") for c in shared], "#piece")

    return cut(left, True), cut(right, False)


def leaves(node) -> list[TriplePattern]:
    return [x for side in node for x in leaves(side)] if isinstance(node, tuple) else [node]


def variables(node) -> list[str]:
    return list(dict.fromkeys(v for t in leaves(node) for v in t.variables))


def keyed(node, known: set[str]) -> bool:
    """Whether all variables follow from the known ones by properties of subjects."""
    known, rest = set(known), [t for t in leaves(node) if not isinstance(t.p, Var)]
    while found := [t for t in rest if not isinstance(t.s, Var) or t.s.name in known]:
        known.update(v for t in found for v in t.variables)
        rest = [t for t in rest if t not in found]
    return known.issuperset(variables(node))


def multiplies(a, b) -> bool:
    """Whether both sides may have many rows for the values they share."""
    shared = {*variables(a)} & {*variables(b)}
    return bool(variables(a) and variables(b)) and not keyed(a, shared) and not keyed(b, shared)


def arranged(node):
    """The same joins; a side that only adds properties to rows of a multiplying join goes below it."""
    if not isinstance(node, tuple):
        return node
    a, b = arranged(node[0]), arranged(node[1])
    for one, other in ((a, b), (b, a)):
        if isinstance(one, tuple) and multiplies(*one):
            shared = {*variables(one)} & {*variables(other)}
            for x, y in (one, one[::-1]):
                if shared and shared.issubset(variables(x)) and keyed(other, shared):
                    return arranged(((x, other), y))
    return a, b


def after(df: DataFrame, offset: int) -> DataFrame:
    """All rows but the first of a written copy, in the order of its tasks: no task gets all rows."""
    held = settled(df.withColumn("#row", F.monotonically_increasing_id()))
    sizes = {r["task"]: r["n"] for r in held.groupBy(F.shiftright("#row", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for task, n in sorted(sizes.items()):
        if offset < n:
            return held.where(F.col("#row") >= (task << 33) + offset).drop("#row")
        offset -= n
    return held.where(F.lit(False)).drop("#row")


def compile_plan(graph, plan: Plan, tree: str = "LEFT_LINEAR", single: bool = False) -> DataFrame:
    """``single``: every pattern's rows go to one task, as a check on the distributed plan."""

    def multiplied(node) -> bool:
        return isinstance(node, tuple) and (multiplies(*node) or multiplied(node[0]) or multiplied(node[1]))

    def tree_of(node) -> DataFrame:
        if isinstance(node, tuple):
            a, b = node
            # counting a side evaluates it once more: only where it has no multiplying join itself
            return join(tree_of(a), tree_of(b), not single and multiplies(a, b) and not multiplied(a) and not multiplied(b))
        df = match(graph, node)
        return df.coalesce(1) if single else df

    if isinstance(plan, Slice):
        df = compile_plan(graph, plan.child, tree, single)
        if plan.limit is None:
            return after(df, plan.offset) if plan.offset else df
        df = df.offset(plan.offset) if plan.offset else df
        return df.limit(plan.limit)
    if isinstance(plan, Project):
        return compile_plan(graph, plan.child, tree, single).select(*[F.col(f"`{v}`") for v in plan.names])
    assert isinstance(plan, Bgp)
    written = shape(plan.patterns, tree)
    return tree_of(arranged(written)).select(*[F.col(f"`{v}`") for v in variables(written)])
