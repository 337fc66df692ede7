"""Registered queries of the engine over the star graph, each with its DuckDB counterpart where SQL has one.

The SQL builds the same graph from the tables by itself (CTEs ent, edge, fact below) and
shares no code with the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import snapshot
from graphloom.functions import prob
from graphloom.operators import algebra, analytics, certify, constraints, modal, network, paths, planning, reconcile, retrieve
from graphloom.plans import rpq
from graphloom.plans.fixpoint import cut
from graphloom.plans.parse_native import parse_query, parse_regex
from graphloom.session import GraphSession
from graphloom.snapshot import STEP, TAGS, Graph, Labels, Later
from graphloom.sources import ingest
from graphloom.streaming import store, stream



def star_graph(spark: SparkSession, sf: str) -> Graph:
    return snapshot.stored_star(spark, sf)


def chain_graph(spark: SparkSession, sf: str) -> Graph:
    return snapshot.stored(snapshot.chain_graph, spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_ENT = """ent AS (
  SELECT 10000000000 + r_regionkey AS id, 'Region' AS type, r_name AS name FROM region UNION ALL
  SELECT 20000000000 + n_nationkey, 'Nation', n_name FROM nation UNION ALL
  SELECT 30000000000 + c_custkey, 'Customer', c_name FROM customer UNION ALL
  SELECT 40000000000 + s_suppkey, 'Supplier', s_name FROM supplier UNION ALL
  SELECT 50000000000 + p_partkey, 'Part', p_name FROM part UNION ALL
  SELECT 60000000000 + o_orderkey, 'Order', o_orderkey::varchar FROM orders UNION ALL
  SELECT DISTINCT 90000000000 + substr(o_orderpriority, 1, 1)::bigint, 'Context', o_orderpriority FROM orders)"""
_FACT = """fact AS MATERIALIZED (
  SELECT ('0x' || substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15))::bigint AS fact_id, 60000000000 + l_orderkey AS "order", l_linenumber::bigint AS line,
         50000000000 + l_partkey AS part, 40000000000 + l_suppkey AS supplier, max(cast(1 - l_discount AS float)) AS confidence
  FROM lineitem GROUP BY 1, 2, 3, 4, 5),
fctx AS (SELECT fact_id, 90000000000 + substr(o_orderpriority, 1, 1)::bigint AS ctx_id FROM fact JOIN orders ON o_orderkey + 60000000000 = "order")"""
_EDGE = _FACT + """,
pedge AS MATERIALIZED (
  SELECT 'inRegion' AS rel, 20000000000 + n_nationkey AS src, 10000000000 + n_regionkey AS dst, 1::float AS confidence FROM nation UNION ALL
  SELECT 'inNation', 30000000000 + c_custkey, 20000000000 + c_nationkey, 1 FROM customer UNION ALL
  SELECT 'inNation', 40000000000 + s_suppkey, 20000000000 + s_nationkey, 1 FROM supplier UNION ALL
  SELECT 'placedBy', 60000000000 + o_orderkey, 30000000000 + o_custkey, 1 FROM orders UNION ALL
  SELECT 'hasPart', "order", part, confidence FROM fact UNION ALL
  SELECT 'suppliedBy', part, supplier, confidence FROM fact),
edge AS MATERIALIZED (SELECT DISTINCT rel, src, dst FROM pedge)"""
_TURN = """turn AS (SELECT 70000000000 + conv_id * 1000 + turn AS id, conv_id, turn AS n, role, text FROM conversations),
nxt AS (SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY conv_id ORDER BY n) AS dst FROM turn) WHERE dst IS NOT NULL)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def asks(name: str, text, sql: str | None, lang: str = "native", graph: Callable = star_graph, **options) -> None:
    """Register a query of one of the query languages."""
    options.setdefault("limit", None)
    QUERIES[name] = lambda spark, sf: GraphSession(graph(spark, sf)).query(text, lang, **options)
    if sql:
        ORACLE_SQL[name] = sql


# Scans and atoms ------------------------------------------------------------------------
asks("scan_type", "select ?x where ?x : Customer", "SELECT 30000000000 + c_custkey AS x FROM customer")
asks("scan_subtype", "select ?x where ?x is Agent", "SELECT 30000000000 + c_custkey AS x FROM customer UNION ALL SELECT 40000000000 + s_suppkey FROM supplier")
asks("attr_eq", 'select ?x where ?x.segment = "BUILDING"', "SELECT 30000000000 + c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING'")
asks("attr_list", 'select ?x where attrs(?x, brand="Brand#2", kind="ECONOMY")', "SELECT 50000000000 + p_partkey AS x FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
asks("attr_contains", 'select ?x where ?x : Part, contains(?x, "name", " WIDG ")', "SELECT 50000000000 + p_partkey AS x FROM part WHERE contains(lower(p_name), 'widg')")
asks("fuzzy_name", 'select ?x where fuzzy(?x, "name", "smal rings", 2)', f"WITH {_ENT} SELECT id AS x FROM ent WHERE levenshtein(lower(name), 'smal rings') <= 2")
_TOKENS = "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([A-Za-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda t: lower(t)[:64]), lambda t: length(t) >= 2 AND t NOT IN ('the', 'of', 'and', 'to', 'in', 'a', 'is', 'for', 'on', 'with', 'as', 'by', 'at', 'an', 'or'))"
asks("fts_all", 'select ?x where ?x : Turn, fts(?x, "text", "was the that Are")', f"SELECT 70000000000 + conv_id * 1000 + turn AS x FROM conversations WHERE list_has_all({_TOKENS.format('text')}, ['was', 'that', 'are'])", graph=chain_graph)
asks("fts_any", 'select ?x where fts_any(?x, "text", "sind GetLes")', f"SELECT 70000000000 + conv_id * 1000 + turn AS x FROM conversations WHERE list_has_any({_TOKENS.format('text')}, ['sind', 'get', 'les'])", graph=chain_graph)
asks("project_bag", "select ?n where ?c : Customer, ?c -inNation-> ?n", "SELECT 20000000000 + c_nationkey AS n FROM customer")
asks("project_distinct", "select ?n where ?c : Customer, ?c -inNation-> ?n", "SELECT DISTINCT 20000000000 + c_nationkey AS n FROM customer", distinct=True)
asks("has_multiplicity", "select ?o where ?o has hasPart", f"WITH {_EDGE} SELECT src AS o FROM edge WHERE rel = 'hasPart'")
asks("shape_literal", 'select ?o where ?o { is Order, placedBy, status="F" }', "SELECT 60000000000 + o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'")
asks("lookup_term", 'select ?c where ?c -inNation-> name("NATION_3")', f"WITH {_EDGE} SELECT src AS c FROM edge JOIN nation ON dst = 20000000000 + n_nationkey WHERE rel = 'inNation' AND n_name = 'NATION_3'")
asks("wildcard", "select ?o where _ -inNation-> ?o", f"WITH {_EDGE} SELECT dst AS o FROM edge WHERE rel = 'inNation'")
asks("constant_term", "select ?c where ?c -inNation-> 20000000004", f"WITH {_EDGE} SELECT src AS c FROM edge WHERE rel = 'inNation' AND dst = 20000000004")
asks("grounded", "where 20000000004 -inRegion-> _x", None)
QUERIES["grounded"] = lambda spark, sf: GraphSession(star_graph(spark, sf)).query("where 20000000004 : Nation, 20000000004 -inRegion-> 10000000004")
ORACLE_SQL["grounded"] = "SELECT true AS satisfied FROM nation WHERE n_nationkey = 4 AND n_regionkey = 4"

# Joins ----------------------------------------------------------------------------------------
asks("edge_join", "select ?o ?n where ?o -placedBy-> ?c, ?c -inNation-> ?n", "SELECT 60000000000 + o_orderkey AS o, 20000000000 + c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey")
asks(
    "bgp_cycle", "select ?o ?p ?s where ?o -placedBy-> ?c, ?c -inNation-> ?n, ?s : Supplier, ?s -inNation-> ?n, ?o -hasPart-> ?p, ?p -suppliedBy-> ?s",
    f"""WITH {_EDGE}, home AS MATERIALIZED (SELECT a.src AS o, b.dst AS n FROM edge a JOIN edge b ON b.src = a.dst AND b.rel = 'inNation' WHERE a.rel = 'placedBy'),
    offer AS MATERIALIZED (SELECT e.src AS p, e.dst AS s, c.dst AS n FROM edge e JOIN edge c ON c.src = e.dst AND c.rel = 'inNation' WHERE e.rel = 'suppliedBy')
    SELECT d.src AS o, d.dst AS p, s FROM edge d JOIN home ON home.o = d.src JOIN offer ON offer.p = d.dst AND offer.n = home.n WHERE d.rel = 'hasPart'""",
)
asks("fact_atom_nary", 'select ?o ?p where ?f = LineItem(order=?o, part=?p, supplier=?s), ?s -inNation-> NATION_7', f"WITH {_FACT} SELECT \"order\" AS o, part AS p FROM fact JOIN supplier ON supplier = 40000000000 + s_suppkey WHERE s_nationkey = 7")
asks("context_single", 'select ?o ?s where LineItem(order=?o, supplier=?s) in "1-URGENT"', f"WITH {_FACT} SELECT \"order\" AS o, supplier AS s FROM fact JOIN fctx USING (fact_id) WHERE ctx_id = 90000000001")
asks("context_union", 'select ?f where ?f = LineItem(line=1) in {"1-URGENT", "2-HIGH"}', f"WITH {_FACT} SELECT fact_id AS f FROM fact JOIN fctx USING (fact_id) WHERE line = 1 AND ctx_id IN (90000000001, 90000000002)")
asks("min_conf", "select ?p ?s where ?p -suppliedBy-> ?s min_conf 0.96", f"WITH {_EDGE} SELECT DISTINCT src AS p, dst AS s FROM pedge WHERE rel = 'suppliedBy' AND confidence >= 0.96::float")
asks("or_union_all", "select ?x where ?x -inNation-> 20000000003 or ?x : Customer", "SELECT 30000000000 + c_custkey AS x FROM customer UNION ALL SELECT 30000000000 + c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 40000000000 + s_suppkey FROM supplier WHERE s_nationkey = 3")
asks("sqlish_follow", "SELECT c FROM Customer AS c WHERE FOLLOW(c, 'inNation/inRegion', 'ASIA') AND ATTR(c, 'segment') = 'MACHINERY' LIMIT 5", "SELECT 30000000000 + c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment = 'MACHINERY'", lang="sqlish")
asks("json_ir", {"version": 1, "select": ["?s"], "where": [{"kind": "type", "term": "?s", "type": "Supplier"}, {"kind": "edge", "left": "?s", "path": "inNation", "right": "NATION_5"}]}, "SELECT 40000000000 + s_suppkey AS s FROM supplier WHERE s_nationkey = 5", lang="json")
asks("ask_find", 'ask find Customer with segment = "FURNITURE"', "SELECT 30000000000 + c_custkey AS x FROM customer WHERE c_mktsegment = 'FURNITURE'", lang="ask")
asks("ask_follow", "ask from 30000000001 follow inNation/inRegion", "SELECT 10000000000 + n_regionkey AS y FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1", lang="ask")
asks("limit_default", "select ?x where ?x : Order", None, limit="query")

# Paths -------------------------------------------------------------------------------------------
asks("follow_path3", 'select ?o where ?o -placedBy/inNation/inRegion-> name("EUROPE")', "SELECT 60000000000 + o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
asks("follow_path_conf", "select ?o ?s where ?o -hasPart/suppliedBy-> ?s, ?o.status = \"P\" min_conf 0.97", f"""WITH {_EDGE}, e AS (SELECT DISTINCT rel, src, dst FROM pedge WHERE confidence >= 0.97::float)
SELECT DISTINCT a.src AS o, b.dst AS s FROM e a JOIN e b ON a.dst = b.src AND b.rel = 'suppliedBy' JOIN orders ON a.src = 60000000000 + o_orderkey WHERE a.rel = 'hasPart' AND o_orderstatus = 'P'""")
asks("rpq_alt", "select ?x ?y where ?x : Order, ?x -(placedBy|hasPart)-> ?y", f"WITH {_EDGE} SELECT DISTINCT src AS x, dst AS y FROM edge WHERE rel IN ('placedBy', 'hasPart')")
asks("rpq_opt", "select ?c ?y where ?c : Supplier, ?c -inNation/inRegion?-> ?y", "SELECT 40000000000 + s_suppkey AS c, 20000000000 + s_nationkey AS y FROM supplier UNION SELECT 40000000000 + s_suppkey, 10000000000 + n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_STAR = f"WITH RECURSIVE {_TURN}, reach AS (SELECT id AS x, id AS y FROM turn UNION SELECT x, dst FROM reach JOIN nxt ON y = src) SELECT x, y FROM reach"
asks("rpq_star_chain", "select ?x ?y where ?x : Turn, ?x -next*-> ?y", _STAR, graph=chain_graph)
asks("rpq_plus_chain", "select ?x ?y where ?x -next+-> ?y", _STAR.replace("SELECT id AS x, id AS y FROM turn", "SELECT src AS x, dst AS y FROM nxt"), graph=chain_graph)
asks("rpq_max_hops", "select ?x ?y where ?x : Turn, ?x -next*-> ?y max_hops 2", f"WITH {_TURN} SELECT id AS x, id AS y FROM turn UNION SELECT src, dst FROM nxt UNION SELECT a.src, b.dst FROM nxt a JOIN nxt b ON a.dst = b.src", graph=chain_graph)
asks("rpq_reverse", "select ?x where ?x -next+-> 70000000003", f"WITH RECURSIVE {_TURN}, reach AS (SELECT 70000000003 AS x UNION SELECT src FROM reach JOIN nxt ON x = dst) SELECT x FROM reach WHERE x <> 70000000003", graph=chain_graph)
@query(f"WITH {_TURN} SELECT a.src AS x, c.dst AS y FROM nxt a JOIN nxt b ON a.dst = b.src JOIN nxt c ON b.dst = c.src")
def rpq_strict_hops(spark, sf):
    """A chain of three is bounded only where that is asked for: with two hops there is nothing."""
    s = GraphSession(chain_graph(spark, sf))
    ask = lambda n: s.query(f"select ?x ?y where ?x -next/next/next-> ?y max_hops {n}", limit=None, strict_max_hops=True)
    return ask(2).unionByName(ask(3))


def cyclic_graph(spark: SparkSession, sf: str) -> Graph:
    """The whole star graph and an edge from a region to each supplier: a graph with cycles."""
    g = star_graph(spark, sf)
    ends = lambda: spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey", f"{TAGS['Region'] * STEP} + s_nationkey % 5 as src", f"{TAGS['Supplier'] * STEP} + s_suppkey as dst")
    hosts = lambda df: df.selectExpr("xxhash64('hosts', s_suppkey) as edge_id", "'hosts' as rel", "src", "dst", "cast(0.5 as float) as confidence")
    own = {"hosts": (Later(lambda: hosts(ends())), Later(lambda: hosts(ends().distinct())))}
    return Graph.of(spark, entities=g.entities, edges=Labels(spark, g.labels().own | own))


_CYCLE = """cyc AS (SELECT DISTINCT * FROM (SELECT 'inNation' AS rel, 40000000000 + s_suppkey AS src, 20000000000 + s_nationkey AS dst FROM supplier UNION ALL SELECT 'inNation', 30000000000 + c_custkey, 20000000000 + c_nationkey FROM customer UNION ALL
  SELECT 'inRegion', 20000000000 + n_nationkey, 10000000000 + n_regionkey FROM nation UNION ALL SELECT 'hosts', 10000000000 + s_nationkey % 5, 40000000000 + s_suppkey FROM supplier)),
cnode AS (SELECT 10000000000 + r_regionkey AS id FROM region UNION ALL SELECT 20000000000 + n_nationkey FROM nation UNION ALL SELECT 30000000000 + c_custkey FROM customer UNION ALL SELECT 40000000000 + s_suppkey FROM supplier)"""
_REACH = f"WITH RECURSIVE {_CYCLE}, reach AS (SELECT src AS x, dst AS y FROM cyc UNION SELECT x, dst FROM reach JOIN cyc ON y = src)"
# No edge leads from a cycle to a customer, an order or a part, so each is a component of its own.
_WHOLE = f"""{_ENT}, {_EDGE}, hosts AS (SELECT 10000000000 + s_nationkey % 5 AS src, 40000000000 + s_suppkey AS dst FROM supplier), wedge AS (SELECT src, dst FROM pedge UNION ALL SELECT src, dst FROM hosts)"""
asks("rpq_plus_cycle", "select ?x ?y where ?x : Nation, ?x -(inNation|inRegion|hosts)+-> ?y", f"{_REACH} SELECT x, y FROM reach WHERE x BETWEEN 20000000000 AND 29999999999", graph=cyclic_graph)


@query(f"{_REACH}, back AS (SELECT a.x, a.y FROM reach a JOIN reach b ON a.x = b.y AND a.y = b.x UNION SELECT id, id FROM cnode) SELECT x AS id, min(y) AS component FROM back GROUP BY x UNION ALL SELECT id, id FROM ent WHERE id >= 50000000000".replace("WITH RECURSIVE ", f"WITH RECURSIVE {_ENT}, "))
def strong_components(spark, sf):
    g = cyclic_graph(spark, sf)
    return network.strong_components(g.entities.select("id"), g.edges)


@query(f"""WITH RECURSIVE {_TURN}, both_ AS (SELECT src, dst FROM nxt UNION SELECT dst, src FROM nxt),
reach AS (SELECT id AS x, id AS y FROM turn UNION SELECT x, dst FROM reach JOIN both_ ON y = src) SELECT x AS id, min(y) AS component FROM reach GROUP BY x""")
def weak_components(spark, sf):
    g = chain_graph(spark, sf)
    return network.weak_components(g.entities.select("id"), g.edges)


@query(f"""WITH RECURSIVE {_WHOLE}, w AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM wedge GROUP BY 1, 2), d AS MATERIALIZED (SELECT src, count(*) AS d FROM wedge GROUP BY src),
share AS MATERIALIZED (SELECT w.src, w.dst, m / d AS share FROM w JOIN d USING (src)), n AS MATERIALIZED (SELECT id, (SELECT count(*) FROM ent) AS n, d.src IS NULL AS sink FROM ent LEFT JOIN d ON d.src = id),
pr AS (SELECT 0 AS k, id, 1.0::double / n AS rank, sink FROM n
  UNION ALL SELECT (SELECT max(k) + 1 FROM pr), n.id, 0.15::double / n.n + 0.85::double * (coalesce(g.got, 0) + coalesce((SELECT sum(rank) FROM pr WHERE sink), 0) / n.n), n.sink
  FROM n LEFT JOIN (SELECT s.dst, sum(p.rank * s.share) AS got FROM pr p JOIN share s ON s.src = p.id GROUP BY s.dst) g ON g.dst = n.id WHERE (SELECT max(k) FROM pr) < 30)
SELECT id, round(rank, 9) AS rank FROM pr WHERE k = 30""")
def pagerank(spark, sf):
    g = cyclic_graph(spark, sf)
    return network.pagerank(g.entities.select("id"), g.edges).select("id", F.round("rank", 9).alias("rank"))


@query()
def betweenness(spark, sf):
    g = cyclic_graph(spark, sf)
    return network.betweenness(g.entities.select("id"), g.edges)


@query()
def communities(spark, sf):
    g = cyclic_graph(spark, sf)
    return network.communities(g.entities.select("id"), g.edges)


@query(f"WITH {_EDGE}, {_ENT} SELECT min(o) AS min_n_out, max(o) AS max_n_out, round(avg(o), 6) AS mean_n_out, min(i) AS min_n_in, max(i) AS max_n_in, round(avg(i), 6) AS mean_n_in, min(o + i) AS min_total, max(o + i) AS max_total, round(avg(o + i), 6) AS mean_total FROM (SELECT id, (SELECT count(*) FROM pedge WHERE src = id) AS o, (SELECT count(*) FROM pedge WHERE dst = id) AS i FROM ent)")
def degree_summary(spark, sf):
    g = star_graph(spark, sf)
    d = network.degree_summary(g.entities.select("id"), network.edge_list(g))
    return d.select(*(F.round(c, 6).alias(c) if c.startswith("mean") else F.col(c) for c in d.columns))


@query(f"WITH {_EDGE} SELECT id, count(*) AS total FROM (SELECT src AS id FROM pedge UNION ALL SELECT dst FROM pedge) GROUP BY id ORDER BY total DESC, id LIMIT 15")
def top_degree(spark, sf):
    g = star_graph(spark, sf)
    return network.top(network.degrees(g.entities.select("id"), network.edge_list(g)), "total", 15).select("id", "total")


@query(f"WITH {_EDGE}, {_ENT} SELECT 'type' AS part, type AS name, count(*) AS n FROM ent GROUP BY type UNION ALL SELECT 'label', rel, count(*) FROM pedge GROUP BY rel")
def db_summary(spark, sf):
    return network.summary(star_graph(spark, sf))


@query(f"WITH {_EDGE}, {_ENT} SELECT type AS kind, count(*) AS n FROM ent WHERE id IN (SELECT 60000000007 UNION SELECT dst FROM edge WHERE src = 60000000007 UNION SELECT b.dst FROM edge a JOIN edge b ON a.dst = b.src WHERE a.src = 60000000007) GROUP BY type")
def neighbourhood2(spark, sf):
    g = star_graph(spark, sf)
    nodes, _ = paths.neighbourhood(g, spark.createDataFrame([(6 * STEP + 7,)], "id bigint"), 2, "out")
    return nodes.join(g.types, "id").groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"))


_SIMPLE = f"""WITH {_EDGE}, best AS (SELECT rel, src, dst, max(confidence) AS c FROM pedge GROUP BY ALL),
p AS (SELECT a.dst AS x, b.dst AS y, c.dst AS z, a.c::double * b.c::double * c.c::double AS confidence FROM best a JOIN best b ON a.dst = b.src JOIN best c ON b.dst = c.src WHERE a.src = 60000000005 AND a.rel = 'hasPart' AND b.rel = 'suppliedBy' AND c.rel = 'inNation')"""


@query(f"{_SIMPLE} SELECT x, y, z, round(confidence, 6) AS confidence FROM p")
def simple_paths(spark, sf):
    out = paths.simple_paths(star_graph(spark, sf), 6 * STEP + 5, None, 3, rels=["hasPart", "suppliedBy", "inNation"]).where("length = 3")
    return out.select(F.col("nodes")[1].alias("x"), F.col("nodes")[2].alias("y"), F.col("nodes")[3].alias("z"), F.round("confidence", 6).alias("confidence"))


@query(f"{_SIMPLE} SELECT z AS id, round(max(confidence), 6) AS confidence FROM p GROUP BY z")
def best_confidences(spark, sf):
    out = paths.best_confidences(star_graph(spark, sf), 6 * STEP + 5, 4, rels=["hasPart", "suppliedBy", "inNation"])
    return out.where(f"id between {2 * STEP} and {3 * STEP}").select("id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_EDGE} SELECT src, dst, round(max(confidence), 6) AS confidence FROM pedge WHERE rel = 'suppliedBy' GROUP BY src, dst")
def best_edge(spark, sf):
    return star_graph(spark, sf).best_edges(rels=["suppliedBy"]).select("src", "dst", F.round(F.col("confidence").cast("double"), 6).cast("float").cast("double").alias("confidence")).select("src", "dst", F.round("confidence", 6).alias("confidence"))


ORACLE_SQL["best_edge"] = ORACLE_SQL["best_edge"].replace("round(max(confidence), 6)", "round(max(confidence)::double, 6)")


@query("SELECT a.signature, a.src, b.dst FROM (SELECT 'inNation/inRegion' AS signature, 40000000000 + s_suppkey AS src, s_nationkey FROM supplier) a JOIN (SELECT n_nationkey, 10000000000 + n_regionkey AS dst FROM nation) b ON n_nationkey = s_nationkey UNION ALL SELECT 'inNation', 40000000000 + s_suppkey, 20000000000 + s_nationkey FROM supplier")
def path_index(spark, sf):
    # All labels and sources; the SQL has the suppliers' rows alone.
    return paths.path_index(star_graph(spark, sf), 2)


@query("SELECT 10000000000 + n_regionkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3")
def follow_expression(spark, sf):
    return rpq.reachable(star_graph(spark, sf), 4 * STEP + 3, parse_regex("inNation/inRegion"))


# Algebra, contexts -----------------------------------------------------------------------------------
@query("SELECT 30000000000 + c_custkey AS id FROM customer WHERE c_nationkey = 2 AND false UNION SELECT 20000000000 + c_nationkey FROM customer WHERE c_custkey = 2 UNION SELECT 10000000000 + r_regionkey FROM region")
def algebra_union(spark, sf):
    return algebra.execute(star_graph(spark, sf), algebra.Union(algebra.FollowPath(3 * STEP + 2, ("inNation",)), algebra.SelectByType("Region")))


@query(f"WITH {_EDGE} SELECT DISTINCT e.dst AS id FROM pedge e WHERE rel = 'hasPart' AND src = 60000000009 AND confidence >= 0.95::float")
def algebra_confidence(spark, sf):
    q = algebra.WithConfidence(algebra.Join(algebra.SelectRelated(6 * STEP + 9, "hasPart"), algebra.WithConfidence(algebra.SelectByType("Part"), 0.1)), 0.95)
    return algebra.execute(star_graph(spark, sf), q)


@query(f"WITH {_FACT} SELECT fact_id, CASE ctx_id WHEN 90000000001 THEN 'only_a' ELSE 'only_b' END AS side FROM fctx WHERE ctx_id IN (90000000001, 90000000003)")
def context_diff(spark, sf):
    return algebra.context_diff(star_graph(spark, sf), 9 * STEP + 1, 9 * STEP + 3, "LineItem")


@query(f"WITH {_FACT} SELECT fact_id FROM fact WHERE \"order\" = 60000000011 AND line = 2")
def fact_key_lookup(spark, sf):
    return star_graph(spark, sf).fact_by_key("LineItem", {"order": 6 * STEP + 11, "line": 2})


def _drift_sql(kind: str) -> str:
    term = "p * ln(p / q)" if kind == "kl" else "(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2"
    return f"""WITH a AS (SELECT event_type AS k, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS k, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1),
j AS (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (k)), d AS (SELECT (na + 1.0) / (sum(na) OVER () + count(*) OVER ()) AS p, (nb + 1.0) / (sum(nb) OVER () + count(*) OVER ()) AS q, sum(na) OVER () AS n_a, sum(nb) OVER () AS n_b FROM j)
SELECT round(sum({term}), 9) AS divergence, max(n_a)::bigint AS n_a, max(n_b)::bigint AS n_b, count(*) AS support FROM d"""


def _histograms(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    half = lambda k: e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    return half(0), half(1)


@query(_drift_sql("js"))
def drift_js(spark, sf):
    return analytics.drift(*_histograms(spark, sf), "k").withColumn("divergence", F.round("divergence", 9))


@query(_drift_sql("kl"))
def drift_kl(spark, sf):
    return analytics.drift(*_histograms(spark, sf), "k", kind="kl").withColumn("divergence", F.round("divergence", 9))


@query(f"WITH {_FACT} SELECT ctx_id, 'LineItem' AS relation, count(*) AS n FROM fctx WHERE ctx_id = 90000000004 GROUP BY 1")
def context_histogram(spark, sf):
    return analytics.relation_counts(star_graph(spark, sf), 9 * STEP + 4).withColumn("ctx_id", F.lit(9 * STEP + 4))


# Evidence ---------------------------------------------------------------------------------------
_CERTIFIED = "select ?o ?s where ?o : Order, ?o -hasPart/suppliedBy-> ?s, ?s -inNation-> NATION_7"


@query(f"""WITH {_EDGE}, best AS MATERIALIZED (SELECT rel, src, dst, floor(max(confidence)::double * 1000000 + 0.5)::bigint AS p FROM pedge GROUP BY ALL),
last AS MATERIALIZED (SELECT b.src, b.dst, b.p AS p1, c.p AS p2 FROM best b JOIN best c ON c.src = b.dst AND c.rel = 'inNation' JOIN nation ON c.dst = 20000000000 + n_nationkey AND n_name = 'NATION_7' WHERE b.rel = 'suppliedBy')
SELECT a.src AS o, a.dst AS via, l.dst AS s, 3 AS n, ((a.p * p1 // 1000000) * p2 // 1000000)::bigint AS proof FROM best a JOIN last l ON l.src = a.dst WHERE a.rel = 'hasPart'""")
def certified_rows(spark, sf):
    out = certify.certify(star_graph(spark, sf), parse_query(_CERTIFIED))
    return out.select("o", F.col("_mid1").alias("via"), "s", F.size("witness").alias("n"), "proof")


@query(f"SELECT o, s FROM ({ORACLE_SQL['certified_rows']}) WHERE via % 2 = 0")
def certified_violations(spark, sf):
    """Of certificates of which those through even parts are falsified, the ones that do not verify."""
    g, q = star_graph(spark, sf), parse_query(_CERTIFIED)
    rows = certify.certify(g, q)
    return certify.verify(g, q, rows.withColumn("proof", F.col("proof") + F.when(F.col("_mid1") % 2 == 0, 1).otherwise(0))).select("o", "s")


@query(f"WITH {_EDGE} SELECT rel, src, dst FROM edge WHERE rel IN ('placedBy', 'suppliedBy')")
def learning_graph(spark, sf):
    return planning.learning_graph(star_graph(spark, sf), {"placedBy": ("Order", "Agent"), "suppliedBy": ("Part", "Supplier"), "hasPart": ("Part", "Order")})


# Constraints --------------------------------------------------------------------------------------------
@query(f"WITH {_FACT} SELECT \"order\", line, count(*) AS n FROM fact GROUP BY ALL HAVING count(*) > 1")
def key_violations(spark, sf):
    return constraints.key_violations(star_graph(spark, sf).wide["LineItem"], ["order", "line"])


@query(f"WITH {_FACT} SELECT part, count(DISTINCT supplier) AS n FROM fact GROUP BY part HAVING count(DISTINCT supplier) > 1")
def functional_violations(spark, sf):
    return constraints.functional_violations(star_graph(spark, sf).wide["LineItem"], ["part"], "supplier")


@query(f"WITH {_FACT} SELECT \"order\", count(DISTINCT part) AS n FROM fact GROUP BY 1 HAVING count(DISTINCT part) > 3")
def at_most_violations(spark, sf):
    return constraints.at_most_violations(star_graph(spark, sf).wide["LineItem"], ["order"], "part", 3)


@query("SELECT a, b FROM (SELECT s_suppkey AS a, s_nationkey::bigint AS b FROM supplier UNION SELECT s_nationkey::bigint, s_suppkey FROM supplier)")
def symmetric_closure(spark, sf):
    f = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey as a", "cast(s_nationkey as bigint) as b")
    return constraints.symmetric_closure(f, "a", "b")


@query(f"WITH RECURSIVE {_TURN}, c AS (SELECT src, dst, src // 1000 AS conv FROM nxt), reach AS (SELECT * FROM c UNION SELECT reach.src, c.dst, reach.conv FROM reach JOIN c ON reach.dst = c.src AND reach.conv = c.conv) SELECT * FROM reach")
def transitive_closure(spark, sf):
    e = chain_graph(spark, sf).edges.selectExpr("src", "dst", "src div 1000 as conv")
    return constraints.transitive_closure(e, "src", "dst", ["conv"])


@query(f"""WITH {_FACT} SELECT 'error' AS level, 'key_violation' AS code, count(*) AS n FROM (SELECT 1 FROM fact GROUP BY "order", line HAVING count(*) > 1) UNION ALL
SELECT 'error', 'functional_violation', count(*) FROM (SELECT 1 FROM fact GROUP BY part HAVING count(DISTINCT supplier) > 1) UNION ALL
SELECT 'error', 'at_most_violation', count(*) FROM (SELECT 1 FROM fact GROUP BY "order" HAVING count(DISTINCT part) > 3)""")
def quality_report(spark, sf):
    return constraints.quality_report(star_graph(spark, sf), "strict").groupBy("level", "code").agg(F.count("*").alias("n"))


@query(f"""WITH {_FACT} SELECT 'error' AS level, n, 10.0::double AS weight, n * 10.0::double AS cost FROM (SELECT
(SELECT count(*) FROM (SELECT 1 FROM fact GROUP BY "order", line HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM fact GROUP BY part HAVING count(DISTINCT supplier) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM fact GROUP BY "order" HAVING count(DISTINCT part) > 3)) AS n)""")
def guardrail_cost(spark, sf):
    return analytics.guardrail_cost(constraints.quality_report(star_graph(spark, sf)))


@query("""SELECT 'busy' AS rule, 30000000000 + c_custkey AS id, 'required' AS part FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'idle', 40000000000 + s_suppkey, 'required' FROM supplier UNION ALL SELECT 'free', 60000000000 + o_orderkey, 'forbidden' FROM orders""")
def guardrail_rules(spark, sf):
    g = star_graph(spark, sf)
    turned = g.edges_of(["placedBy"]).select("edge_id", F.lit("placed").alias("rel"), F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")
    rules = [{"name": "busy", "type": "Customer", "required": ["placed"], "forbidden": ["hasPart"], "paths": ["inNation/inRegion"]}, {"name": "idle", "type": "Supplier", "required": ["placed"]}, {"name": "free", "type": "Order", "forbidden": ["placedBy"]}]
    return constraints.guardrail_findings(g.add(edges=turned), rules)


@query("SELECT * FROM (VALUES ('some_orders', 3::bigint, true, 1.0::double, 0.0::double), ('no_such', 0::bigint, false, 2.0::double, 2.0::double)) t(name, rows, satisfied, weight, cost)")
def competency_coverage(spark, sf):
    s = GraphSession(star_graph(spark, sf))
    return analytics.competency_coverage(s, [{"name": "some_orders", "query": "select ?x where ?x : Order", "min_rows": 3}, {"name": "no_such", "query": 'select ?x where ?x : Order, ?x.status = "none"', "weight": 2.0}])


@query("SELECT 'w' || r_regionkey AS world FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)")
def modal_box(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    worlds = spark.read.parquet(f"{sf}/region.parquet").selectExpr("concat('w', r_regionkey) as world")
    access = n.selectExpr("'of' as rel", "concat('w', n_regionkey) as w1", "concat('n', n_nationkey) as w2")
    return modal.box(worlds, access, "of", n.where("n_nationkey >= 3").selectExpr("concat('n', n_nationkey) as world"))


@query("SELECT DISTINCT 'w' || n_regionkey AS world FROM nation WHERE n_nationkey < 3")
def modal_diamond(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    access = n.selectExpr("'of' as rel", "concat('w', n_regionkey) as w1", "concat('n', n_nationkey) as w2")
    return modal.diamond(access, "of", n.where("n_nationkey < 3").selectExpr("concat('n', n_nationkey) as world"))


# Retrieval -------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_dot_product(v, q) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(v, q) DESC, vec_id) AS rank FROM e JOIN q ON vec_id <> query_id)
SELECT query_id, id, round(d, 5) AS score, rank::int AS rank FROM s WHERE rank <= 5""")
def vector_top_k(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return retrieve.top_k_each(e, q, 5).withColumn("score", F.round("score", 5))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) AS norm, 1.0::double AS unit FROM embeddings")
def vector_normalize(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = F.col("embedding")
    return e.select(F.col("vec_id").alias("id"), F.round(F.sqrt(retrieve.dot(v, v)), 5).alias("norm"), F.round(retrieve.dot(retrieve.normalized(v), retrieve.normalized(v)), 5).alias("unit"))


@query()
def token_hash_search(spark, sf):
    g = chain_graph(spark, sf)
    texts = cut(g.attrs.where("key = 'text'").select("id", retrieve.token_hash(F.col("value")).alias("vector")))
    q = texts.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return retrieve.top_k_blocks(texts, q, 12)


@query("SELECT DISTINCT 10000000000 + n_regionkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey < 4")
def expand_hits(spark, sf):
    g = star_graph(spark, sf)
    return retrieve.expand(g, g.entities.where(f"type = 'Supplier' and id < {4 * STEP + 4}"), ["inNation", "inRegion"])


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS w"


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, {_WORDS} FROM conversations), f AS (SELECT item_id, {_WORDS} FROM benchmark)
SELECT id, round(coalesce(max(len(list_intersect(w.w, f.w)) / len(list_distinct(list_concat(w.w, f.w)))), 0), 9) AS score FROM w, f GROUP BY 1""")
def grounding(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return retrieve.grounding(c, b).select("id", F.round("score", 9).alias("score"))


# Ingestion ---------------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS text, unnest(range(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')))) AS n FROM documents)
SELECT doc_id || '_' || n AS chunk_id, doc_id, 'para_' || n AS span, md5(text) AS digest FROM p""")
def text_chunks(spark, sf):
    return ingest.text_chunks(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "\n").select("chunk_id", "doc_id", "span", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT conv_id || '_' || turn AS chunk_id, conv_id, role AS speaker, md5(text) AS digest FROM conversations WHERE NOT ends_with(text, '?')")
def conversation_chunks(spark, sf):
    return ingest.conversation_chunks(spark.read.parquet(f"{sf}/conversations.parquet")).select("chunk_id", "conv_id", "speaker", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']+)["'']', 1) AS h FROM pages) SELECT page_id, (unnest(range(len(h))))::int AS n, unnest(h) AS href FROM l""")
def page_links(spark, sf):
    return ingest.page_links(spark.read.parquet(f"{sf}/pages.parquet"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", ingest.page_title(F.col("html")).alias("title"))


_HTML_TEXT = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '</(p|div|li|tr|h[1-6])>|<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'gs'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ')"""


@query(f"SELECT page_id, {_HTML_TEXT} AS text FROM pages")
def page_text(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", ingest.html_text(F.col("html")).alias("text"))


@query()
def wiki_sections(spark, sf):
    return ingest.wiki_sections(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS name_key FROM part")
def name_keys(spark, sf):
    from graphloom.functions.text import name_key

    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), name_key(F.col("p_brand")).alias("name_key"))


# Evidence and weights --------------------------------------------------------------------------------------------
@query("SELECT event_type AS key, round(1 - product(1 - (value % 1)::double * 0.01), 6) AS confidence, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1")
def fact_aggregation(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("value >= 0").select(F.col("event_id").alias("position"), F.lit("d").alias("domain"), F.col("event_type").alias("statement"), ((F.col("value") % 1) * 0.01).alias("confidence"))
    return analytics.aggregate_facts(e).select(F.expr("substring(key, 3)").alias("key"), F.round("confidence", 6).alias("confidence"), "n")


@query("SELECT least(floor(l_tax * 100), 9)::int AS bin, count(*) AS n, round(avg(l_tax * 10), 6) AS mean_confidence, round(avg((l_returnflag = 'R')::int), 6) AS accuracy FROM lineitem GROUP BY 1")
def calibration_bins(spark, sf):
    r = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_tax") * 10).alias("confidence"), (F.col("l_returnflag") == "R").cast("int").alias("correct"))
    return analytics.calibration_bins(r).select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


ORACLE_SQL["calibration_bins"] = ORACLE_SQL["calibration_bins"].replace("floor(l_tax * 100)", "floor((l_tax * 10) * 10)")


@query("SELECT o_orderkey AS id, floor(o_totalprice / 10000000 * 1000000 + 0.5)::bigint AS fixed FROM orders")
def fixed_point(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), prob.fixed(F.col("o_totalprice") / 10000000).alias("fixed"))


@query("SELECT o_orderkey AS fact_id, round(pow(0.5, (epoch(timestamp '1999-01-01') - epoch(o_orderdate)) / 86400.0 / 365), 6) AS weight FROM orders WHERE pow(0.5, (epoch(timestamp '1999-01-01') - epoch(o_orderdate)) / 86400.0 / 365) >= 0.1")
def weight_decay(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("fact_id"), F.lit(1.0).alias("weight"), F.col("o_orderdate").alias("ts"))
    return reconcile.decay_all(o, F.lit("1999-01-01").cast("timestamp"), 365).select("fact_id", F.round("weight", 6).alias("weight"))


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type")
def fact_conflicts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("fact_id"), F.col("user_id").cast("string").alias("subject"), F.lit("kind").alias("attribute"), F.col("event_type").alias("value"), (F.col("value") / 100).alias("weight"))
    return reconcile.conflicts(e).select("a", "b")


_ARRIVAL = "{{'value': {0}.value, 'weight': {1}, 'fact_id': {0}.fact_id, 'state': {2}, 'merged': {3}}}"


@query(f"""SELECT subject, attribute, h.value AS value, h.weight AS weight, h.fact_id AS fact_id, h.state AS state, h.merged AS merged FROM (
SELECT user_id::varchar AS subject, 'kind' AS attribute, list_reduce(list({{'value': event_type, 'weight': least(value / 100, 1.0)::double, 'fact_id': event_id, 'state': 'kept', 'merged': 0::bigint}} ORDER BY event_id),
lambda a, x: CASE WHEN x.value = a.value THEN {_ARRIVAL.format("a", "1 - (1 - a.weight) * (1 - x.weight)", "a.state", "a.merged + 1")}
WHEN (x.weight >= 0.95::double AND a.weight < 0.95::double) OR x.weight - a.weight >= 0.2::double THEN {_ARRIVAL.format("x", "x.weight", "'replaced'", "a.merged")}
WHEN x.weight - a.weight <= -0.2::double THEN {_ARRIVAL.format("a", "a.weight", "'kept'", "a.merged")}
WHEN x.weight - a.weight >= 0.1::double THEN {_ARRIVAL.format("x", "x.weight", "'merged'", "a.merged + 1")}
WHEN a.weight - x.weight >= 0.1::double THEN {_ARRIVAL.format("a", "a.weight", "'merged'", "a.merged + 1")}
ELSE {_ARRIVAL.format("a", "a.weight", "'review'", "a.merged")} END) AS h FROM events GROUP BY 1)""")
def fact_reconciliation(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("fact_id"), F.col("user_id").cast("string").alias("subject"), F.lit("kind").alias("attribute"), F.col("event_type").alias("value"), F.least(F.col("value") / 100, F.lit(1.0)).alias("weight"), F.col("event_id").alias("arrived"))
    return reconcile.reconcile(e)


@query("SELECT c_custkey % 7 AS a, CASE WHEN abs(c_custkey % 7 - 3) * 200000 >= 300000 THEN CASE WHEN c_custkey % 7 > 3 THEN 'choose_first' ELSE 'choose_second' END WHEN abs(c_custkey % 7 - 3) * 400000 >= 300000 THEN 'merge' ELSE 'review' END AS decision FROM customer")
def conflict_decision(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 7).alias("a"))
    return c.select("a", prob.decide(F.col("a") * 200000, F.lit(600000), 300000).alias("decision"))


# Versions and streams ----------------------------------------------------------------------------------------------
@query("SELECT key, value FROM (SELECT user_id AS key, event_type AS value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 700) WHERE r = 1 AND value <> 'error'")
def versioned_read(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("value"))
    return store.versioned_read(e, 700)


@query("SELECT time_bucket(interval '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return stream.event_windows(spark.read.parquet(f"{sf}/events.parquet"))


ORACLE_SQL["event_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
QUERIES["event_windows"] = lambda spark, sf: stream.event_windows(spark.read.parquet(f"{sf}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {_FACT} SELECT fact_id, field FROM (SELECT fact_id, unnest(['order', 'line', 'part', 'supplier']) AS field FROM fact)")
def masked_tuples(spark, sf):
    return stream.masked_tuples(spark, star_graph(spark, sf).wide["LineItem"]).select("fact_id", "field")
