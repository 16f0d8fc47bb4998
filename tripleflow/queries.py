"""The registered queries of the graph engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import RDF_TYPE
from .operators import covers, dictionary, statistics, telemetry, validate
from .operators.graph import settled, spread
from .plans.parser import parse
from .plans.planner import compile_plan
from .sources.ntriples import parse_lines
from .sources.sinks import decoded, dot_edges
from .sources.tables import StoredGraph, TableGraph, triples_sql

CHUNKS = 4
SHOP = ["region", "nation", "customer", "supplier", "orders"]
SMALL = ["region", "nation", "supplier"]

# name: (tables, query, options); a query without SQL of its own gets it from its patterns
BGP: dict[str, tuple[list[str], str, dict]] = {
    "tp_none": (SMALL, "SELECT ?s ?p ?o { ?s ?p ?o }", {}),
    "tp_s": (SHOP, "SELECT ?p ?o { <urn:orders/5> ?p ?o }", {}),
    "tp_p": (SHOP, "SELECT ?s ?o { ?s <urn:o_custkey> ?o }", {}),
    "tp_o": (SHOP, 'SELECT ?s ?p { ?s ?p <urn:nation/3> }', {}),
    "tp_sp": (SHOP, "SELECT ?o { <urn:customer/7> <urn:c_nationkey> ?o }", {}),
    "tp_so": (SHOP, "SELECT ?p { <urn:nation/3> ?p <urn:nation> }", {}),
    "tp_po": (SHOP, 'SELECT ?s { ?s <urn:o_orderstatus> "F" }', {}),
    "tp_spo": (SHOP, "SELECT ?s ?o { <urn:nation/3> a <urn:nation> . ?s <urn:r_name> ?o }", {}),
    "tp_type": (SHOP, "SELECT ?s { ?s a <urn:supplier> }", {}),
    "tp_unknown_const": (SHOP, "SELECT ?p ?o { <urn:orders/nowhere> ?p ?o }", {}),
    "join_single_var": (SHOP, "SELECT ?ord ?seg { ?ord <urn:o_custkey> ?c . ?c <urn:c_mktsegment> ?seg }", {}),
    "join_multi_var": (SHOP, "SELECT ?a ?b ?n { ?a <urn:c_nationkey> ?n . ?a <urn:c_mktsegment> ?g . ?b <urn:s_nationkey> ?n . ?a a ?t }", {}),
    "join_star": (SHOP, "SELECT ?o ?c ?st ?pr { ?o <urn:o_custkey> ?c ; <urn:o_orderstatus> ?st ; <urn:o_orderpriority> ?pr }", {}),
    "join_chain": (SHOP, "SELECT ?o ?r { ?o <urn:o_custkey> ?c . ?c <urn:c_nationkey> ?n . ?n <urn:n_regionkey> ?k . ?k <urn:r_name> ?r }", {}),
    "join_cartesian": (SMALL, "SELECT ?a ?b { ?a a <urn:region> . ?b a <urn:nation> }", {}),
    "join_left_forward": (SHOP, 'SELECT ?s ?n { ?s <urn:n_name> ?n . <urn:nation/3> <urn:n_regionkey> ?any . <urn:nation/3> a <urn:nation> }', {}),
    "join_right_forward": (SHOP, "SELECT ?s ?n { <urn:nation/3> a <urn:nation> . ?s <urn:n_name> ?n }", {}),
    "join_forward_empty": (SHOP, "SELECT ?s ?n { <urn:nation/3> a <urn:region> . ?s <urn:n_name> ?n }", {}),
    "tree_left": (SHOP, 'SELECT ?o ?seg ?n { ?o <urn:o_orderstatus> "F" . ?o <urn:o_custkey> ?c . ?c <urn:c_mktsegment> ?seg . ?c <urn:c_nationkey> ?n }', {"tree": "LEFT_LINEAR"}),
    "tree_right": (SHOP, 'SELECT ?o ?seg ?n { ?o <urn:o_orderstatus> "F" . ?o <urn:o_custkey> ?c . ?c <urn:c_mktsegment> ?seg . ?c <urn:c_nationkey> ?n }', {"tree": "RIGHT_LINEAR"}),
    "tree_bushy": (SHOP, 'SELECT ?o ?seg ?n { ?o <urn:o_orderstatus> "F" . ?o <urn:o_custkey> ?c . ?c <urn:c_mktsegment> ?seg . ?c <urn:c_nationkey> ?n }', {"tree": "BUSHY"}),
    "base_ops": (SMALL, "SELECT ?s ?r { ?s <urn:s_nationkey> ?n . ?n <urn:n_regionkey> ?r }", {"single": True}),
    "project_subset": (SHOP, "SELECT ?seg { ?c <urn:c_mktsegment> ?seg . ?c <urn:c_nationkey> ?n }", {}),
    "project_reorder": (SHOP, "SELECT ?n ?c { ?c <urn:c_nationkey> ?n }", {}),
    "project_bag": (SHOP, "SELECT ?st { ?o <urn:o_orderstatus> ?st }", {}),
    "select_star": (SMALL, "SELECT * { ?s <urn:s_nationkey> ?n . ?n <urn:n_name> ?name }", {}),
    "nested_project": (SMALL, "SELECT ?n { { SELECT ?n ?s { ?s <urn:s_nationkey> ?n } } }", {}),
    "prefixes": (SHOP, "PREFIX u: <urn:> SELECT ?o ?c { ?o u:o_custkey ?c ; a u:orders }", {}),
    "join_lineitem": (["orders", "lineitem"], 'SELECT ?f ?c { ?l <urn:l_returnflag> ?f . ?l <urn:l_orderkey> ?o . ?o <urn:o_orderstatus> "F" . ?o <urn:o_custkey> ?c }', {}),
    "blank_in_pattern": (SHOP, "SELECT ?o ?seg { ?o <urn:o_custkey> [ <urn:c_mktsegment> ?seg ] }", {}),
}


def _graph(tables: list[str]) -> str:
    return f"t AS ({triples_sql(tables)})"


def bgp_sql(tables: list[str], text: str) -> str:
    """A query as self-joins of the triple table."""
    from .plans.algebra import Bgp, Project, Slice, Var

    plan, names = parse(text), None
    while not isinstance(plan, Bgp):
        if isinstance(plan, Project):
            names = names or plan.names
        assert not isinstance(plan, Slice)
        plan = plan.child
    where, bound, froms = [], {}, []
    for i, t in enumerate(plan.patterns):
        own = [f"t{i}.{c} = '{x}'" for c, x in zip("spo", (t.s, t.p, t.o), strict=True) if not isinstance(x, Var)]
        if not t.variables:
            where.append(f"EXISTS (SELECT 1 FROM t AS t{i} WHERE {' AND '.join(own)})")
            continue
        froms.append(f"t AS t{i}")
        where += own
        for c, x in zip("spo", (t.s, t.p, t.o), strict=True):
            if isinstance(x, Var):
                if x.name in bound:
                    where.append(f"{bound[x.name]} = t{i}.{c}")
                else:
                    bound[x.name] = f"t{i}.{c}"
    return f"WITH {_graph(tables)} SELECT {', '.join(f'{bound[v]} AS {v}' for v in names)} FROM {', '.join(froms)}" + (f" WHERE {' AND '.join(where)}" if where else "")


def _bgp(tables: list[str], text: str, options: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: decoded(compile_plan(TableGraph(spark, d, tables), parse(text), **options))


def _triples(spark: SparkSession, d: str, tables: list[str] | None = None) -> DataFrame:
    return TableGraph(spark, d, tables or ["region", "nation", "customer", "supplier"]).triples


PLACED = ["region", "nation", "customer", "supplier"]


def _chunk_sql(column: str, chunks: int = CHUNKS) -> str:
    m = f"md5({column})"
    x = f"xor(xor(('0x' || substr({m}, 1, 8))::BIGINT, ('0x' || substr({m}, 9, 8))::BIGINT), xor(('0x' || substr({m}, 17, 8))::BIGINT, ('0x' || substr({m}, 25, 8))::BIGINT))"
    return f"CAST(abs((CASE WHEN {x} >= 2147483648 THEN {x} - 4294967296 ELSE {x} END) % {chunks}) AS INT)"


_COVER = f"{_graph(PLACED)}, c AS (SELECT s, p, o, {_chunk_sql('s')} AS chunk FROM t)"
_STATS = f"{_COVER}, r AS (SELECT s AS term, chunk, 1 AS sf, 0 AS pf, 0 AS of_ FROM c UNION ALL SELECT p, chunk, 0, 1, 0 FROM c UNION ALL SELECT o, chunk, 0, 0, 1 FROM c), st AS (SELECT term, chunk, sum(sf)::BIGINT AS sf, sum(pf)::BIGINT AS pf, sum(of_)::BIGINT AS of_ FROM r GROUP BY ALL)"
_HOP1 = f"{_COVER}, h0 AS (SELECT DISTINCT s, chunk FROM c), h1 AS (SELECT * FROM h0 UNION SELECT o, chunk FROM h0 JOIN t USING (s) WHERE o IN (SELECT s FROM t))"
_HOP2 = f"{_HOP1}, h2 AS (SELECT * FROM h1 UNION SELECT o, chunk FROM h1 JOIN t USING (s) WHERE o IN (SELECT s FROM t))"


def _cover(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: covers.STRATEGIES[name](settled(_triples(spark, d)), CHUNKS)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.frequencies(covers.hash_cover(_triples(spark, d), CHUNKS))


def _estimate(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        cover = settled(covers.hash_cover(_triples(spark, d), CHUNKS))
        return statistics.estimate(parse(text), settled(statistics.frequencies(cover)), statistics.chunk_sizes(cover))

    return run


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    big = F.col("value") > 50
    metrics = {
        "avg_value": telemetry.rounded(F.avg("value")),
        "hit_rate": telemetry.rounded(F.avg(F.when(big, 1.0).otherwise(0.0)) * 100),
        "avg_large": telemetry.rounded(F.avg(F.when(big, F.col("value")))),
    }
    return telemetry.intervals(_events(spark, d), "event_id", "event_type", 100, metrics)


_NUMBERED = "e AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) AS n, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS bucket FROM events)"
_ROUND = "floor({} * 100 + 0.5) / 100"
_INTERVALS = f"{_NUMBERED}, ends AS (SELECT bucket, min(event_id) AS first, max(event_id) AS last, count(*) AS everything FROM e GROUP BY bucket), own AS (SELECT bucket, event_type AS file, count(*) AS events, {_ROUND.format('avg(value)')} AS avg_value, {_ROUND.format('(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100)')} AS hit_rate, {_ROUND.format('avg(CASE WHEN value > 50 THEN value END)')} AS avg_large FROM e GROUP BY bucket, event_type)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """The graph as N-Triples lines with comments and broken lines among them, parsed again."""
    t = _triples(spark, d, SMALL)
    line = F.concat_ws(" ", "s", "p", "o", F.lit("."))
    noise = t.where(F.col("p") == RDF_TYPE).select(F.explode(F.array(F.lit("# remark"), F.concat(F.lit("<broken "), "s"))).alias("value"))
    parsed = parse_lines(t.select(line.alias("value")).unionAll(noise))
    return parsed.where(F.col("s").isNotNull()).select("s", "p", "o").distinct()


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.build(_triples(spark, d))


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    t = settled(_triples(spark, d))
    terms = settled(dictionary.build(t))
    return dictionary.decode(dictionary.encode(t, terms), terms)


def _owned(spark: SparkSession, d: str) -> DataFrame:
    t = settled(covers.hash_cover(_triples(spark, d), CHUNKS))
    terms = settled(dictionary.build(t))
    owners = statistics.owners(statistics.frequencies(t)).join(terms, "term").select("id", "owner")
    owned = dictionary.with_owner(dictionary.encode(t, terms).select("s", "p", "o"), owners)
    return owned.select(*[c for x in "spo" for c in (dictionary.without_owner(x).alias(f"{x}_id"), F.shiftright(x, dictionary.OWNER_BITS).cast("int").alias(f"{x}_owner"))])


def _validate_cover(spark: SparkSession, d: str) -> DataFrame:
    """A cover from which the names of nations are gone and in which regions are twice: both must be found, and nothing else."""
    t = settled(_triples(spark, d))
    c = settled(covers.containment(covers.n_hop(covers.hash_cover(t, CHUNKS), 1)).select("s", "p", "o"))
    spoilt = c.where("p <> '<urn:n_name>'").unionAll(c.where("p = '<urn:r_name>'"))
    return validate.differences(t, spoilt).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def _slice(spark: SparkSession, d: str, limits: str) -> DataFrame:
    """Size of the slice, and how many different rows of it the whole answer has."""
    answer = lambda x: decoded(compile_plan(TableGraph(spark, d, SHOP), parse(f"SELECT ?o {{ ?o <urn:o_custkey> ?c }} {x}")))
    part = settled(answer(limits))
    inside = part.join(answer(""), "o", "left_semi").agg(F.countDistinct("o").alias("inside"))
    return part.agg(F.count(F.lit(1)).alias("n")).join(inside, F.lit(True))


def _self_loops(spark: SparkSession, d: str) -> DataFrame:
    loops = _triples(spark, d, SMALL).where(F.col("p") == RDF_TYPE).select("s", F.lit("<urn:same>").alias("p"), F.col("s").alias("o"))
    graph = StoredGraph(_triples(spark, d, SMALL).unionAll(loops))
    return decoded(compile_plan(graph, parse("SELECT ?x ?p { ?x ?p ?x }")))


def _wrong_owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners of nations are moved by one chunk: just those must be found, with what is right."""
    stats = settled(_stats(spark, d))
    moved = F.when(F.startswith("term", F.lit("<urn:nation/")), (F.col("owner") + 1) % CHUNKS).otherwise(F.col("owner"))
    return validate.wrong_owners(stats, statistics.owners(stats).withColumn("owner", moved)).select("term", "owner", "right")


def _cover_check(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """What must hold of any cover by subject: nothing lost or doubled, subjects whole, chunks in range."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = settled(_triples(spark, d))
        c = settled(covers.STRATEGIES[name](t, CHUNKS))
        counted = spread(c, c.count(), "s", "p", "o").agg(F.count(F.lit(1)).alias("placed"), F.countDistinct("s", "p", "o").alias("different"), F.count(F.when(~F.col("chunk").between(0, CHUNKS - 1), 1)).alias("outside"))
        split = c.groupBy("s").agg(F.countDistinct("chunk").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("split"))
        lost = validate.unplaced(t, c).agg(F.count(F.lit(1)).alias("lost"))
        return counted.join(split, F.lit(True)).join(lost, F.lit(True))

    return run


_COVER_CHECK = "SELECT count(*) AS placed, count(*) AS different, 0::BIGINT AS outside, 0::BIGINT AS split, 0::BIGINT AS lost FROM t"


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "slice_limit": (lambda s, d: _slice(s, d, "LIMIT 25"), "SELECT least(25, count(*)) AS n, least(25, count(*)) AS inside FROM orders"),
    "slice_offset": (lambda s, d: _slice(s, d, "OFFSET 10"), "SELECT greatest(0, count(*) - 10) AS n, greatest(0, count(*) - 10) AS inside FROM orders"),
    "slice_zero": (lambda s, d: _slice(s, d, "LIMIT 0"), "SELECT 0::BIGINT AS n, 0::BIGINT AS inside"),
    "tp_repeated_var": (_self_loops, f"WITH {_graph(SMALL)} SELECT s AS x, '<urn:same>' AS p FROM t WHERE p = '{RDF_TYPE}'"),
    **{f"check_{k}": (_cover_check(name), f"WITH {_graph(PLACED)} {_COVER_CHECK}") for k, name in (("hierarchical", "HIERARCHICAL"), ("mec", "MIN_EDGE_CUT"), ("mec_over", "MEC_OVER"), ("edge_coloring", "EDGE_COLORING"), ("molecule", "MOLECULE_HASH"))},
    "dict_densify": (
        lambda s, d: dictionary.densify(s.read.parquet(f"{d}/orders.parquet"), "o_custkey"),
        "SELECT o_custkey AS id, row_number() OVER (ORDER BY o_custkey) AS dense FROM (SELECT DISTINCT o_custkey FROM orders)",
    ),
    "telemetry_storage_series": (
        lambda s, d: telemetry.storage_series(_events(s, d), "event_id", "user_id", F.col("value") > 50),
        f"WITH {_NUMBERED}, x AS (SELECT n, (value > 50)::BIGINT AS disk, lag((value > 50)::BIGINT) OVER (PARTITION BY user_id ORDER BY n) AS was FROM e) SELECT n, CAST(sum(disk - coalesce(was, 0)) OVER upto AS BIGINT) AS on_disk, CAST(sum(1 - disk - coalesce(1 - was, 0)) OVER upto AS BIGINT) AS in_memory FROM x WINDOW upto AS (ORDER BY n)",
    ),
    "telemetry_flush_rate": (
        lambda s, d: telemetry.flush_rate(_events(s, d), "event_id", "event_type", 100, F.col("user_id") % 3 == 0, F.col("value") > 50),
        f"WITH {_NUMBERED} SELECT bucket, event_type AS file, coalesce({_ROUND.format('(sum(CASE WHEN user_id % 3 = 0 AND value > 50 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) / nullif(count(*) FILTER (user_id % 3 = 0), 0))')}, 0.0::DOUBLE) AS flush_dirty_rate FROM e GROUP BY bucket, event_type",
    ),
    "telemetry_cache_series": (
        lambda s, d: telemetry.last_values(_events(s, d), "event_id", "event_type", 100, F.col("value")),
        f"WITH {_NUMBERED} SELECT bucket, event_type AS file, arg_max(value, event_id) AS value FROM e GROUP BY bucket, event_type",
    ),
    "ntriples_scan": (_lines, f"WITH {_graph(SMALL)} SELECT s, p, o FROM t"),
    "triple_count": (lambda s, d: _triples(s, d, SHOP).agg(F.count(F.lit(1)).alias("n")), f"WITH {_graph(SHOP)} SELECT count(*) AS n FROM t"),
    "cover_hash": (_cover("HASH"), f"WITH {_COVER} SELECT s, p, o, chunk FROM c"),
    "cover_vertical": (_cover("VERTICAL"), f"WITH {_graph(PLACED)} SELECT s, p, o, {_chunk_sql('p')} AS chunk FROM t"),
    "cover_hierarchical": (_cover("HIERARCHICAL"), None),
    "cover_mec": (_cover("MIN_EDGE_CUT"), None),
    "cover_mec_over": (_cover("MEC_OVER"), None),
    "cover_edge_coloring": (_cover("EDGE_COLORING"), None),
    "cover_molecule": (_cover("MOLECULE_HASH"), None),
    "nhop_1": (lambda s, d: covers.n_hop(_cover("HASH")(s, d), 1), f"WITH {_HOP1} SELECT s, p, o, h1.chunk FROM h1 JOIN t USING (s)"),
    "nhop_2": (lambda s, d: covers.n_hop(_cover("HASH")(s, d), 2), f"WITH {_HOP2} SELECT s, p, o, h2.chunk FROM h2 JOIN t USING (s)"),
    "containment": (
        lambda s, d: covers.containment(covers.n_hop(_cover("HASH")(s, d), 1)).select("s", "p", "o", F.array_join(F.transform("containment", lambda x: x.cast("string")), ",").alias("chunks")),
        f"WITH {_HOP1} SELECT s, p, o, string_agg(CAST(h1.chunk AS VARCHAR), ',' ORDER BY h1.chunk) AS chunks FROM h1 JOIN t USING (s) GROUP BY s, p, o",
    ),
    "dict_encode": (_dictionary, f"WITH {_graph(PLACED)}, w AS (SELECT s AS term FROM t UNION SELECT p FROM t UNION SELECT o FROM t) SELECT row_number() OVER (ORDER BY term) AS id, term FROM w"),
    "dict_decode": (_round_trip, f"WITH {_graph(PLACED)} SELECT s, p, o FROM t"),
    "stats_collect": (lambda s, d: _stats(s, d).withColumnRenamed("of", "objf"), f"WITH {_STATS} SELECT term, chunk, sf, pf, of_ AS objf FROM st"),
    "stats_chunk_sizes": (lambda s, d: statistics.chunk_sizes(covers.hash_cover(_triples(s, d), CHUNKS)), f"WITH {_COVER} SELECT chunk, count(*) AS triples FROM c GROUP BY chunk"),
    "stats_lookup": (
        lambda s, d: statistics.totals(_stats(s, d)).where(F.col("term").isin("<urn:nation/3>", RDF_TYPE)).withColumnRenamed("of", "objf"),
        f"WITH {_STATS} SELECT term, sum(sf)::BIGINT AS sf, sum(pf)::BIGINT AS pf, sum(of_)::BIGINT AS objf FROM st WHERE term IN ('<urn:nation/3>', '{RDF_TYPE}') GROUP BY term",
    ),
    "stats_row": (
        lambda s, d: statistics.matrix(_stats(s, d), CHUNKS).select("term", F.array_join(F.transform("row", lambda x: x.cast("string")), ",").alias("counts")),
        f"WITH {_STATS}, k AS (SELECT unnest(range({CHUNKS})) AS chunk), g AS (SELECT w.term, k.chunk, coalesce(st.sf, 0) AS sf, coalesce(st.pf, 0) AS pf, coalesce(st.of_, 0) AS of_ FROM (SELECT DISTINCT term FROM st) w CROSS JOIN k LEFT JOIN st ON st.term = w.term AND st.chunk = k.chunk) SELECT term, string_agg(sf::VARCHAR, ',' ORDER BY chunk) || ',' || string_agg(pf::VARCHAR, ',' ORDER BY chunk) || ',' || string_agg(of_::VARCHAR, ',' ORDER BY chunk) AS counts FROM g GROUP BY term",
    ),
    "owner_assign": (lambda s, d: statistics.owners(_stats(s, d)), f"WITH {_STATS} SELECT term, chunk AS owner FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY sf DESC, of_ DESC, pf DESC, chunk) AS k FROM st) WHERE k = 1"),
    "owner_rewrite": (
        _owned,
        f"WITH {_STATS}, w AS (SELECT term, row_number() OVER (ORDER BY term) AS id FROM (SELECT DISTINCT term FROM st)), ow AS (SELECT term, chunk AS owner FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY sf DESC, of_ DESC, pf DESC, chunk) AS k FROM st) WHERE k = 1), x AS (SELECT w.term, id, owner FROM w JOIN ow ON w.term = ow.term) SELECT a.id AS s_id, a.owner AS s_owner, b.id AS p_id, b.owner AS p_owner, y.id AS o_id, y.owner AS o_owner FROM c JOIN x a ON a.term = c.s JOIN x b ON b.term = c.p JOIN x y ON y.term = c.o",
    ),
    "owner_check": (
        _wrong_owners,
        f"WITH {_STATS}, ow AS (SELECT term, chunk AS owner FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY sf DESC, of_ DESC, pf DESC, chunk) AS k FROM st) WHERE k = 1) SELECT term, ((owner + 1) % {CHUNKS})::INT AS owner, owner AS right FROM ow WHERE term LIKE '<urn:nation/%'",
    ),
    "estimate_match": (
        _estimate("SELECT ?s { ?s <urn:c_nationkey> <urn:nation/3> }"),
        f"WITH {_STATS}, k AS (SELECT DISTINCT chunk FROM c) SELECT k.chunk, least(coalesce(a.pf, 0), coalesce(b.of_, 0))::DOUBLE AS load FROM k LEFT JOIN st a ON a.chunk = k.chunk AND a.term = '<urn:c_nationkey>' LEFT JOIN st b ON b.chunk = k.chunk AND b.term = '<urn:nation/3>'",
    ),
    "estimate_join": (
        _estimate("SELECT ?s { ?s <urn:s_nationkey> ?n . ?n <urn:n_name> ?m }"),
        f"WITH {_STATS}, k AS (SELECT DISTINCT chunk FROM c) SELECT chunk, (SELECT sum(pf) FROM st WHERE term = '<urn:s_nationkey>')::DOUBLE * (SELECT sum(pf) FROM st WHERE term = '<urn:n_name>') / (SELECT count(*) FROM k) AS load FROM k",
    ),
    "validate_cover": (_validate_cover, "SELECT 'missing' AS side, count(*) AS n FROM nation UNION ALL SELECT 'extra', count(*) FROM region"),
    "cover_balance": (
        lambda s, d: validate.balance(covers.hash_cover(_triples(s, d), CHUNKS)),
        f"WITH {_COVER}, z AS (SELECT chunk, count(*) AS triples FROM c GROUP BY chunk) SELECT chunk, triples, round(triples * 100 / (SELECT avg(triples) FROM z), 2) AS of_mean FROM z",
    ),
    "cover_dot": (
        lambda s, d: dot_edges(covers.hash_cover(_triples(s, d, SMALL), CHUNKS)),
        f"WITH {_graph(SMALL)} SELECT '  \"' || replace(s, '\"', '\\\"') || '\" -> \"' || replace(o, '\"', '\\\"') || '\" [label=\"' || p || '\", colorscheme=set312, color=' || ({_chunk_sql('s')} % 12 + 1)::VARCHAR || '];' AS line FROM t",
    ),
    "telemetry_intervals": (
        lambda s, d: _intervals(s, d).select("bucket", "file", "first", "last", "events", "avg_value", "hit_rate", "avg_large"),
        f"WITH {_INTERVALS} SELECT bucket, file, first, last, events, avg_value, hit_rate, avg_large FROM own JOIN ends USING (bucket)",
    ),
    "telemetry_access_rate": (lambda s, d: telemetry.access_rate(_intervals(s, d)), f"WITH {_INTERVALS} SELECT bucket, file, {_ROUND.format('(events * 100 / everything)')} AS access_rate FROM own JOIN ends USING (bucket)"),
    "telemetry_records": (
        lambda s, d: telemetry.interval_records(_intervals(s, d), ["avg_value"]),
        f"WITH {_INTERVALS} SELECT file, unnest([first, last]) AS row_id, avg_value FROM own JOIN ends USING (bucket)",
    ),
    "telemetry_blocks": (
        lambda s, d: telemetry.access_counts(_events(s, d), "event_id", "event_type", F.col("user_id") % 10, 100),
        f"WITH {_NUMBERED} SELECT bucket, event_type AS file, user_id % 10 AS block, count(*) AS accesses FROM e GROUP BY ALL",
    ),
    "telemetry_switches": (
        lambda s, d: telemetry.switches(_events(s, d), "event_id", F.col("event_type") == "click"),
        f"WITH {_NUMBERED} SELECT n AS position FROM e WHERE event_type = 'click'",
    ),
    "telemetry_flow": (
        lambda s, d: telemetry.flow(_events(s, d), F.col("event_type"), F.col("user_id") % 3, F.col("value") > 50),
        "SELECT event_type AS source, user_id % 3 AS target, value > 50 AS reason, count(*) AS n FROM events GROUP BY ALL",
    ),
    "telemetry_storage": (
        lambda s, d: telemetry.storage_states(_events(s, d), "event_id", "user_id", F.col("value") > 50),
        "SELECT count(*) FILTER (disk) AS on_disk, count(*) FILTER (NOT disk) AS in_memory FROM (SELECT arg_max(value > 50, event_id) AS disk FROM events GROUP BY user_id)",
    ),
    "telemetry_counter": (lambda s, d: telemetry.counter(_events(s, d), "event_type"), "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _bgp(*v) for k, v in BGP.items()} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: bgp_sql(t, q) for k, (t, q, _) in BGP.items()} | {k: sql for k, (_, sql) in OTHERS.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments of the customers of finished orders."""
    text = 'SELECT ?ord ?seg WHERE { ?ord <urn:o_custkey> ?cust . ?cust <urn:c_mktsegment> ?seg . ?ord <urn:o_orderstatus> "F" }'
    return compile_plan(TableGraph(spark, sf_dir, ["orders", "customer"]), parse(text))
