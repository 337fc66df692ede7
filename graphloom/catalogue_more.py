"""More registered queries: operators that the first catalogue does not reach, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalogue import _CYCLE, _EDGE, _ENT, _FACT, _REACH, _WHOLE, chain_graph, cyclic_graph, query, star_graph
from graphloom.functions import prob, text
from graphloom.operators import algebra, analytics, constraints, migrate, modal, network, paths, planning, reconcile, retrieve, vectors
from graphloom.plans import rpq
from graphloom.plans.parse_native import parse_regex
from graphloom.session import GraphSession
from graphloom.snapshot import STEP
from graphloom.sources import ingest
from graphloom.streaming import store, stream


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Scans ---------------------------------------------------------------
@query("SELECT 30000000000 + c_custkey AS id, 'Customer' AS type, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = 7")
def entity_fetch(spark, sf):
    return star_graph(spark, sf).entity(3 * STEP + 7).select("id", "type", F.col("attrs")["name"].alias("name"), F.col("attrs")["segment"].alias("segment"))


@query(f"WITH {_EDGE} SELECT rel, dst, round(confidence::double, 6) AS confidence FROM pedge WHERE src = 60000000012 AND rel = 'hasPart'")
def outgoing_typed(spark, sf):
    return star_graph(spark, sf).outgoing(6 * STEP + 12, "hasPart").select("rel", "dst", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query(f"WITH {_EDGE} SELECT rel, src, count(*) AS n FROM pedge WHERE dst = 30000000004 GROUP BY ALL")
def incoming_any(spark, sf):
    return star_graph(spark, sf).incoming(3 * STEP + 4).groupBy("rel", "src").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGE} SELECT rel, dst FROM pedge WHERE src = 60000000012")
def outgoing_any(spark, sf):
    return star_graph(spark, sf).outgoing(6 * STEP + 12).select("rel", "dst")


@query(f"WITH {_FACT} SELECT fact_id FROM fact")
def facts_by_relation(spark, sf):
    return star_graph(spark, sf).fact_nodes("LineItem")


@query(f"WITH {_FACT} SELECT fact_id FROM fact UNION ALL SELECT fact_id FROM fact WHERE false")
def facts_by_schema(spark, sf):
    g = star_graph(spark, sf)
    return g.fact_nodes("LineItem", "Star").unionByName(g.fact_nodes("LineItem", "Other"))


@query(f"WITH {_FACT} SELECT fact_id FROM fctx WHERE ctx_id = 90000000002")
def facts_by_context(spark, sf):
    return star_graph(spark, sf).fact_nodes(ctx=9 * STEP + 2)


@query(f"WITH {_FACT} SELECT fact_id FROM fctx WHERE ctx_id = 90000000005")
def facts_by_all(spark, sf):
    return star_graph(spark, sf).fact_nodes("LineItem", "Star", 9 * STEP + 5)


@query("SELECT 40000000000 + a.s_suppkey AS id, 'same_nation' AS kind FROM supplier a JOIN supplier b USING (s_nationkey) WHERE b.s_suppkey = 3 AND a.s_suppkey <> 3")
def equivalents(spark, sf):
    s = _table(spark, sf, "supplier").select((F.col("s_suppkey") + 4 * STEP).alias("id"), "s_nationkey")
    pairs = s.join(s.withColumnRenamed("id", "other").where(f"other = {4 * STEP + 3}"), "s_nationkey").where("id <> other")
    g = star_graph(spark, sf).add(equivalences=pairs.select(F.col("other").alias("a"), F.col("id").alias("b"), F.lit("same_nation").alias("kind")))
    return g.equivalents(4 * STEP + 3)


@query(f"WITH {_FACT} SELECT field, count(*) AS n, min(dst) AS least, max(dst) AS greatest FROM (SELECT unnest(['order', 'line', 'part', 'supplier']) AS field, unnest([\"order\", line, part, supplier]) AS dst FROM fact) GROUP BY 1")
def fact_field_edges(spark, sf):
    return star_graph(spark, sf).field_edges("LineItem").groupBy(F.col("rel").alias("field")).agg(F.count("*").alias("n"), F.min("dst").alias("least"), F.max("dst").alias("greatest"))


@query("SELECT 40000000000 + s_suppkey AS id FROM supplier WHERE s_acctbal < 0")
def virtual_type(spark, sf):
    ids = _table(spark, sf, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") + 4 * STEP).alias("id"))
    return star_graph(spark, sf).mark_virtual_type(ids, "Debtor").type_scan("Debtor")


@query("SELECT 30000000000 + c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS segment FROM customer")
def attribute_upsert(spark, sf):
    g = star_graph(spark, sf)
    new = _table(spark, sf, "customer").where("c_acctbal < 0").select((F.col("c_custkey") + 3 * STEP).alias("id"), F.lit("segment").alias("key"), F.lit("DEBTOR").alias("value"))
    return g.add(attrs=new).attrs.where("key = 'segment'").select("id", F.col("value").alias("segment"))


# Query forms --------------------------------------------------------------
@query("SELECT 60000000000 + o_orderkey AS o, 30000000000 + o_custkey AS c FROM orders WHERE o_orderstatus = 'F'")
def implicit_select(spark, sf):
    return GraphSession(star_graph(spark, sf)).query('where ?o.status = "F", ?o -placedBy-> ?c', limit=None)


@query("SELECT 30000000000 + c_custkey AS x FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 40000000000 + s_suppkey FROM supplier")
def implicit_select_or(spark, sf):
    return GraphSession(star_graph(spark, sf)).query("where ?x : Customer, ?x -inNation-> NATION_3, ?x -inNation-> ?n or ?x : Supplier", limit=None)


@query("SELECT least(20, count(*)) AS n, least(20, count(*)) AS orders FROM orders")
def limit_counts(spark, sf):
    g = star_graph(spark, sf)
    rows = GraphSession(g).query("select ?x where ?x : Order")
    return rows.agg(F.count("*").alias("n")).crossJoin(rows.join(g.type_scan("Order").toDF("x"), "x", "left_semi").agg(F.count("*").alias("orders")))  # one row each


@query("SELECT 5::bigint AS five, true AS truncated, (SELECT count(*) FROM region) AS all_regions, false AS all_truncated")
def truncation(spark, sf):
    s = GraphSession(star_graph(spark, sf))
    some, more = s.rows("select ?x where ?x : Order limit 5")
    all_, none = s.rows("select ?x where ?x : Region limit 5")
    return spark.createDataFrame([(len(some), more, len(all_), none)], "five bigint, truncated boolean, all_regions bigint, all_truncated boolean")


# Paths ------------------------------------------------------------------------
@query(f"WITH {_EDGE} SELECT 'out' AS way, dst AS id FROM edge WHERE rel = 'hasPart' AND src = 60000000021 UNION ALL SELECT 'in', src FROM edge WHERE rel = 'placedBy' AND dst = 30000000002 UNION ALL SELECT DISTINCT 'sure', dst FROM pedge WHERE rel = 'hasPart' AND src = 60000000021 AND confidence >= 0.95::float")
def neighbour_sets(spark, sf):
    g = star_graph(spark, sf)
    way = lambda name, df: df.select(F.lit(name).alias("way"), "id")
    return way("out", paths.neighbours(g, 6 * STEP + 21, "hasPart")).unionByName(way("in", paths.neighbours(g, 3 * STEP + 2, "placedBy", backward=True))).unionByName(way("sure", paths.neighbours(g, 6 * STEP + 21, "hasPart", min_conf=0.95)))


@query(f"""WITH {_EDGE} SELECT EXISTS (SELECT 1 FROM edge WHERE rel = 'inRegion' AND src = 20000000004 AND dst = 10000000004) AS there, EXISTS (SELECT 1 FROM edge WHERE rel = 'inRegion' AND src = 20000000004 AND dst = 10000000000) AS other,
EXISTS (SELECT 1 FROM pedge WHERE rel = 'inRegion' AND src = 20000000004 AND dst = 10000000004 AND confidence > 1) AS surer""")
def edge_tests(spark, sf):
    g = star_graph(spark, sf)
    found = [paths.has_edge(g, 2 * STEP + 4, "inRegion", STEP + 4), paths.has_edge(g, 2 * STEP + 4, "inRegion", STEP), paths.has_edge(g, 2 * STEP + 4, "inRegion", STEP + 4, 1.5)]
    return spark.createDataFrame([tuple(found)], "there boolean, other boolean, surer boolean")


@query(f"WITH {_EDGE} SELECT 'forth' AS way, a.src, b.dst FROM edge a JOIN edge b ON a.dst = b.src AND b.rel = 'inRegion' WHERE a.rel = 'inNation' AND a.src = 40000000005 UNION ALL SELECT DISTINCT 'back', a.src, b.dst FROM edge a JOIN edge b ON a.dst = b.src AND b.rel = 'inRegion' WHERE a.rel = 'inNation' AND b.dst = 10000000001")
def path_index_probe(spark, sf):
    ix = paths.path_index(star_graph(spark, sf), 2, ["inNation", "inRegion"])
    way = lambda name, df: df.select(F.lit(name).alias("way"), "src", "dst")
    return way("forth", paths.probe(ix, ["inNation", "inRegion"], src=4 * STEP + 5)).unionByName(way("back", paths.probe(ix, ["inNation", "inRegion"], dst=STEP + 1)))


@query(f"{_REACH} SELECT (SELECT count(*) FROM reach WHERE x = 20000000003 AND y = 20000000003) > 0 AS on_cycle, 3::bigint AS hops")
def shortest_witness(spark, sf):
    found = rpq.witnesses(cyclic_graph(spark, sf), parse_regex("(inNation|inRegion|hosts)+"), 2 * STEP + 3, 2 * STEP + 3)
    return spark.createDataFrame([(found is not None, len(found or []))], "on_cycle boolean, hops bigint")


@query("SELECT 30000000000 + c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' UNION ALL SELECT 40000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def reached_backward(spark, sf):
    return rpq.reachable(star_graph(spark, sf), 2 * STEP + 7, parse_regex("inNation"), backward=True)


_CHAINS = f"""WITH {_EDGE}, best AS MATERIALIZED (SELECT rel, src, dst, max(confidence)::double AS c FROM pedge GROUP BY ALL),
p AS MATERIALIZED (SELECT a.src AS o, a.dst AS x, b.dst AS y, c.dst AS z, a.c * b.c * c.c AS c FROM best a JOIN best b ON a.dst = b.src AND b.rel = 'suppliedBy' JOIN best c ON b.dst = c.src AND c.rel = 'inNation' WHERE a.src = 60000000005 AND a.rel = 'hasPart')"""


@query(f"{_CHAINS} SELECT z, round(max(c), 6) AS confidence FROM p WHERE z = (SELECT min(z) FROM p) GROUP BY z")
def best_single_path(spark, sf):
    g = star_graph(spark, sf)
    least = rpq.reachable(g, 6 * STEP + 5, parse_regex("hasPart/suppliedBy/inNation")).agg(F.min("id")).first()[0]
    return paths.best_path(g, 6 * STEP + 5, least, 3, ["hasPart", "suppliedBy", "inNation"]).select(F.element_at("nodes", -1).alias("z"), F.round("confidence", 6).alias("confidence"))


@query(f"{_CHAINS} SELECT count(*) AS n FROM p a JOIN p b ON a.z = b.z AND (a.x, a.y) < (b.x, b.y) WHERE abs(a.c - b.c) > 0.05")
def conflicting_paths(spark, sf):
    g = star_graph(spark, sf)
    out = paths.simple_paths(g, 6 * STEP + 5, None, 3, rels=["hasPart", "suppliedBy", "inNation"]).where("length = 3")
    pairs = paths.path_conflicts(out.select("nodes", "confidence"), 0.05)
    return pairs.where(F.element_at("nodes_a", -1) == F.element_at("nodes_b", -1)).agg(F.count("*").alias("n"))


# Metrics --------------------------------------------------------------------
@query(f"""WITH RECURSIVE {_CYCLE}, e AS (SELECT src, dst FROM cyc UNION SELECT dst, src FROM cyc), r AS (SELECT id AS x, id AS y FROM cnode WHERE id < 20000000000 UNION SELECT x, e.dst FROM r JOIN e ON y = e.src WHERE y < 30000000000 OR y >= 40000000000)
SELECT count(*) AS n_components, max(size) AS giant, round(max(size) / sum(size), 9) AS giant_ratio FROM (SELECT count(*) AS size FROM (SELECT y, min(x) AS least FROM r GROUP BY y) GROUP BY least)""")
def component_sizes(spark, sf):
    g = cyclic_graph(spark, sf)
    nodes = g.entities.where("type in ('Region', 'Nation', 'Customer', 'Supplier')").select("id")
    return network.component_summary(network.weak_components(nodes, network.edge_list(g, nodes)))[0].withColumn("giant_ratio", F.round("giant_ratio", 9))


@query(f"WITH {_WHOLE}, k AS (SELECT id // 10000000000 AS c, id FROM ent), m AS (SELECT count(*) AS m FROM wedge), i AS (SELECT count(*) AS i FROM wedge WHERE src // 10000000000 = dst // 10000000000), d AS (SELECT x // 10000000000 AS c, count(*) AS d FROM (SELECT src AS x FROM wedge UNION ALL SELECT dst FROM wedge) GROUP BY 1) SELECT round((SELECT i FROM i) / m - sum(pow(d / (2.0 * m), 2)), 9) AS modularity FROM d, m GROUP BY m")
def modularity(spark, sf):
    g = cyclic_graph(spark, sf)
    labels = g.entities.select("id", F.expr(f"id div {STEP}").alias("c"))
    return network.modularity(labels, g.edges).select(F.round("modularity", 9).alias("modularity"))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS hits, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS n_found, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O') AS n_held_out")
def precision_recall(spark, sf):
    o = _table(spark, sf, "orders")
    return analytics.precision_recall(o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey")).select("hits", "n_found", "n_held_out")


@query("SELECT p_brand AS name, p_type AS role, max(p_size / 100.0)::double AS confidence, count(DISTINCT p_size) AS n FROM part GROUP BY 1, 2")
def mention_roles(spark, sf):
    p = _table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("role"), (F.col("p_size") / 100.0).alias("confidence"), F.array(F.col("p_size").cast("string")).alias("evidence"))
    return analytics.mention_roles(p).select("name", "role", "confidence", F.size("evidence").cast("bigint").alias("n"))


@query("SELECT p_type AS type, trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS name_key, arg_min(p_brand, p_partkey) AS name, max(p_retailprice) AS confidence, count(*) AS n, arg_max(p_size, (p_retailprice, p_partkey))::varchar AS size FROM part GROUP BY 1, 2")
def merged_proposals(spark, sf):
    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_type").alias("type"), F.col("p_brand").alias("name"), F.col("p_retailprice").alias("confidence"), F.array("p_name").alias("evidence"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attrs"))
    return analytics.merge_proposals(p)[0].select("type", "name_key", "name", "confidence", "n", F.col("attrs")["size"].alias("size"))


@query("SELECT p_type AS type, trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS name_key, count(DISTINCT p_size) AS n_values FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1")
def proposal_conflicts(spark, sf):
    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_type").alias("type"), F.col("p_brand").alias("name"), F.col("p_retailprice").alias("confidence"), F.array("p_name").alias("evidence"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attrs"))
    return analytics.merge_proposals(p)[1].select("type", "name_key", "n_values")


@query("SELECT event_type AS k, round(p, 9) AS p, round(q, 9) AS q FROM (SELECT event_type, (sum((user_id % 2 = 0)::int) + 1.0) / (sum(sum((user_id % 2 = 0)::int)) OVER () + count(*) OVER ()) AS p, (sum((user_id % 2 = 1)::int) + 1.0) / (sum(sum((user_id % 2 = 1)::int)) OVER () + count(*) OVER ()) AS q FROM events GROUP BY 1)")
def drift_terms(spark, sf):
    e = _table(spark, sf, "events")
    half = lambda k: e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    return analytics.drift_terms(half(0), half(1), "k", k=1000).select("k", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


_BINS = "b AS (SELECT least(floor(l_discount * 10), 9)::int AS bin, count(*) AS n, avg((l_returnflag = 'R')::int) AS accuracy FROM lineitem GROUP BY 1)"


@query(f"WITH {_BINS} SELECT l_orderkey, l_linenumber, round(least(n / 100.0, 1) * accuracy + (1 - least(n / 100.0, 1)) * l_discount, 6) AS calibrated FROM lineitem JOIN b ON bin = least(floor(l_discount * 10), 9)::int")
def calibrated_confidence(spark, sf):
    line = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("confidence"), (F.col("l_returnflag") == "R").cast("int").alias("correct"))
    table = analytics.calibration_bins(line.select("confidence", "correct"))
    return analytics.calibrated(line.drop("correct"), table).select("l_orderkey", "l_linenumber", F.round("calibrated", 6).alias("calibrated"))


@query("""WITH RECURSIVE k AS MATERIALIZED (SELECT l_tax::double AS x, (l_returnflag = 'R')::int::double AS y, count(*)::double AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT 0 AS i, 1.0::double AS a, 0.0::double AS b UNION ALL SELECT i + 1, a - 0.01::double * (SELECT sum((1 / (1 + exp(-(p.a * x + p.b))) - y) * n * x) / sum(n) FROM k), b - 0.01::double * (SELECT sum((1 / (1 + exp(-(p.a * x + p.b))) - y) * n) / sum(n) FROM k) FROM p WHERE i < 100)
SELECT round(a, 8) AS a, round(b, 8) AS b FROM p WHERE i = 100""")
def platt_scaling(spark, sf):
    a, b = analytics.platt(_table(spark, sf, "lineitem").select(F.col("l_tax").alias("confidence"), (F.col("l_returnflag") == "R").cast("int").alias("correct")))
    return spark.createDataFrame([(round(a, 8), round(b, 8))], "a double, b double")


@query("SELECT 'v' || n_nationkey AS var, round(a1 * x1 / (a0 * x0 + a1 * x1), 6) AS belief FROM (SELECT n_nationkey, 1 - 0.5 - n_regionkey / 20.0 AS a0, 0.5 + n_regionkey / 20.0 AS a1, 0.8 * (1 - (0.2 + n_regionkey / 10.0)) + 0.2 * (0.2 + n_regionkey / 10.0) AS x0, 0.2 * (1 - (0.2 + n_regionkey / 10.0)) + 0.8 * (0.2 + n_regionkey / 10.0) AS x1 FROM nation)")
def beliefs_of_pairs(spark, sf):
    """Each nation's variable with one neighbour of its own: sum-product is exact there."""
    n = _table(spark, sf, "nation")
    first = n.selectExpr("concat('v', n_nationkey) as var", "1 - 0.5D - n_regionkey / 20.0D as p0", "0.5D + n_regionkey / 20.0D as p1")
    second = n.selectExpr("concat('w', n_nationkey) as var", "1 - (0.2D + n_regionkey / 10.0D) as p0", "0.2D + n_regionkey / 10.0D as p1")
    pairs = n.selectExpr("concat('f', n_nationkey) as factor", "concat('v', n_nationkey) as a", "concat('w', n_nationkey) as b", "0.8D as p00", "0.2D as p01", "0.2D as p10", "0.8D as p11")
    both = first.unionByName(second)
    return analytics.belief_propagation(both.select("var"), both, pairs, 3).where("var like 'v%'").select("var", F.round("belief", 6).alias("belief"))


# Retrieval --------------------------------------------------------------------
@query("SELECT c_custkey AS id, greatest(c_acctbal, s_acctbal) AS score FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey < 100000) FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey IS NOT NULL ORDER BY score DESC, id LIMIT 50")
def hybrid_scores(spark, sf):
    c = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    s = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return retrieve.hybrid_search(c, s, 50)


@query("SELECT 30000000000 + c_custkey AS id, c_acctbal AS score FROM customer WHERE c_nationkey = 2 AND false UNION ALL SELECT 20000000000 + n_nationkey, n_regionkey::double FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey = 6")
def hits_on_path(spark, sf):
    hits = _table(spark, sf, "nation").select((F.col("n_nationkey") + 2 * STEP).alias("id"), F.col("n_regionkey").cast("double").alias("score"))
    return retrieve.follow_hits(star_graph(spark, sf), hits, 4 * STEP + 6, ["inNation"])


@query("SELECT r_name AS name, 'Region' AS type, 10000000000 + r_regionkey AS id FROM region UNION ALL SELECT 'no such', 'Region', NULL")
def resolved_names(spark, sf):
    wanted = _table(spark, sf, "region").selectExpr("r_name as name", "'Region' as type").unionByName(spark.createDataFrame([("no such", "Region")], "name string, type string"))
    return retrieve.resolve_names(wanted, star_graph(spark, sf).entities)


@query("SELECT keyword, id FROM (SELECT 'region' AS keyword, 10000000000 + r_regionkey AS id FROM region UNION ALL SELECT 'supplier', 40000000000 + s_suppkey FROM supplier) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id) <= 5")
def grounded_keywords(spark, sf):
    return retrieve.ground_keywords(star_graph(spark, sf), "Which Region has the Supplier?")


@query(f"WITH {_ENT} SELECT 20000000000 + n_nationkey AS id, n_name || ' ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def neighbour_texts(spark, sf):
    g = star_graph(spark, sf)
    out = retrieve.entity_texts(g).where(f"id between {2 * STEP} and {3 * STEP - 1}")
    parts = F.split("text", " ")
    return out.select("id", F.concat_ws(" ", F.filter(parts, lambda x: x.startswith("NATION")), F.filter(parts, lambda x: ~x.startswith("NATION"))).alias("text"))


_TOKENS = "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([A-Za-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda t: lower(t)[:64]), lambda t: length(t) >= 2)"


@query(f"SELECT 70000000000 + conv_id * 1000 + turn AS id FROM conversations WHERE list_has_any({_TOKENS}, ['was', 'sind'])")
def searched_texts(spark, sf):
    return retrieve.search_text(chain_graph(spark, sf), "text", "was sind")


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_0-9]+'))) AS symbol FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT event_type AS symbol FROM events)
SELECT 'f' || doc_id AS file, symbol, 0.75::double AS confidence FROM t JOIN s USING (symbol)""")
def linked_mentions(spark, sf):
    chunks = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("f"), "doc_id").alias("file"), "text")
    symbols = _table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.lit("home").alias("file")).distinct()
    return retrieve.link_mentions(chunks, symbols).select("file", "symbol", F.col("confidence").cast("double").alias("confidence"))


# Constraints and planning ---------------------------------------------------------------
@query("SELECT 30000000000 + c_custkey AS id, c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def value_constraint(spark, sf):
    return constraints.value_violations(star_graph(spark, sf), "segment", one_of=["BUILDING", "MACHINERY"])


@query("SELECT 60000000000 + o_orderkey AS id, o_orderkey::varchar AS value FROM orders WHERE o_orderkey > 50 UNION ALL SELECT 10000000000 + r_regionkey, r_name FROM region UNION ALL SELECT 20000000000 + n_nationkey, n_name FROM nation UNION ALL SELECT 30000000000 + c_custkey, c_name FROM customer UNION ALL SELECT 40000000000 + s_suppkey, s_name FROM supplier UNION ALL SELECT 50000000000 + p_partkey, p_name FROM part UNION ALL SELECT DISTINCT 90000000000 + substr(o_orderpriority, 1, 1)::bigint, o_orderpriority FROM orders")
def number_constraint(spark, sf):
    return constraints.value_violations(star_graph(spark, sf), "name", between=(0, 50))


@query(f"WITH {_FACT} SELECT 'LineItem' AS relation, count(*) AS n FROM fact")
def ill_typed_facts(spark, sf):
    """Suppliers turned into parts: every fact has a field of a wrong type."""
    g = star_graph(spark, sf)
    from dataclasses import replace

    wrong = g.wide["LineItem"].withColumn("supplier", F.col("part"))
    bad = constraints.fact_type_violations(replace(g, wide={"LineItem": wrong}))
    return bad.select("fact_id").distinct().agg(F.lit("LineItem").alias("relation"), F.count("*").alias("n")).select("relation", "n")


@query("SELECT 'new' AS change, 'key_violation' AS code")
def quality_change(spark, sf):
    before = spark.createDataFrame([("a", "at_most_violation")], "subject string, code string")
    after = before.unionByName(spark.createDataFrame([("b", "key_violation")], before.schema))
    return constraints.quality_delta(before, after).select("change", "code")


@query("SELECT 'likes' AS rel, c_name AS source, r_name AS target, 0.5::double AS confidence, sha256(concat_ws('|', 'likes', c_name, r_name)) AS proposal_id FROM customer, region WHERE c_nationkey = 1")
def proposed_relations(spark, sf):
    a = _table(spark, sf, "customer").where("c_nationkey = 1").select(F.col("c_name").alias("name"))
    return planning.propose_relations("likes", a, _table(spark, sf, "region").select(F.col("r_name").alias("name")), "cross").withColumn("confidence", F.col("confidence").cast("double"))


@query("SELECT sha256(concat_ws('|', 'Stay', n_name, n_regionkey)) AS proposal_id, 'Stay' AS relation, n_name AS name, n_regionkey::varchar AS region FROM nation")
def proposed_facts(spark, sf):
    rows = _table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return planning.propose_facts("Stay", rows).select("proposal_id", "relation", F.col("fields")["name"].alias("name"), F.col("fields")["region"].alias("region"))


@query("SELECT 'some_' || t AS name FROM (SELECT unnest(['Agent', 'Context', 'Customer', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'LineItem', 'hasPart', 'inNation', 'inRegion', 'placedBy', 'suppliedBy']) AS t)")
def competency_questions(spark, sf):
    return spark.createDataFrame([(q["name"],) for q in analytics.competency_questions(star_graph(spark, sf).meta)], "name string")


# Worlds -----------------------------------------------------------------------------
def _worlds(spark, sf):
    n = _table(spark, sf, "nation")
    worlds = n.selectExpr("concat('n', n_nationkey) as world")
    access = n.selectExpr("'ideal' as rel", "concat('n', n_nationkey) as w1", "concat('n', (n_nationkey * 7 + 3) % 25) as w2").unionByName(n.selectExpr("'ideal' as rel", "concat('n', n_nationkey) as w1", "concat('n', (n_nationkey + 1) % 25) as w2"))
    return worlds, access, n.where("n_nationkey % 3 > 0").selectExpr("concat('n', n_nationkey) as world")


_HOLDS = "(({0} * 7 + 3) % 25) % 3 > 0", "(({0} + 1) % 25) % 3 > 0"
_BOTH, _ANY = (" {} ".format(w).join(h.format("n_nationkey") for h in _HOLDS) for w in ("AND", "OR"))


@query(f"SELECT 'n' || n_nationkey AS world, {_BOTH} AS obligatory, {_ANY} AS permitted, NOT ({_ANY}) AS forbidden FROM nation WHERE {_BOTH} OR {_ANY} OR NOT ({_ANY})")
def duties(spark, sf):
    worlds, access, holds = _worlds(spark, sf)
    mark = lambda df, c: df.select("world", F.lit(True).alias(c))
    out = worlds.join(mark(modal.obligatory(worlds, access, holds), "obligatory"), "world", "left").join(mark(modal.permitted(access, holds), "permitted"), "world", "left").join(mark(modal.forbidden(worlds, access, holds), "forbidden"), "world", "left")
    return out.select("world", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("obligatory", "permitted", "forbidden")))


@query("""WITH RECURSIVE a AS (SELECT n_nationkey AS x, (n_nationkey * 7 + 3) % 25 AS y FROM nation WHERE n_nationkey < 25), r AS (SELECT x, y FROM a UNION SELECT r.x, a.y FROM r JOIN a ON a.x = r.y)
SELECT 'n' || n_nationkey AS world FROM nation WHERE n_nationkey <> 8 AND n_nationkey NOT IN (SELECT x FROM r WHERE y = 8)""")
def common_knowledge(spark, sf):
    n = _table(spark, sf, "nation")
    access = n.selectExpr("'a' as rel", "concat('n', n_nationkey) as w1", "concat('n', (n_nationkey * 7 + 3) % 25) as w2")
    return modal.common_knowledge(n.selectExpr("concat('n', n_nationkey) as world"), access, ["a"], n.where("n_nationkey <> 8").selectExpr("concat('n', n_nationkey) as world"), depth=50)


@query("SELECT false AS reflexive, false AS symmetric, false AS transitive, true AS serial, false AS euclidean")
def frame_properties(spark, sf):
    worlds, access, _ = _worlds(spark, sf)
    p = modal.frame_properties(worlds, access, "ideal")
    return spark.createDataFrame([tuple(p.values())], ", ".join(f"{k} boolean" for k in p))


@query(f"SELECT 20000000000 + n_nationkey AS id FROM nation WHERE {_ANY}")
def modal_entities(spark, sf):
    worlds, access, holds = _worlds(spark, sf)
    frame = worlds.select("world", (F.substring("world", 2, 9).cast("bigint") + 2 * STEP).alias("entity"))
    return modal.entity_query(frame, access, "diamond", "ideal", holds.select((F.substring("world", 2, 9).cast("bigint") + 2 * STEP).alias("id")))


# Weights and text ----------------------------------------------------------------------------
@query("SELECT o_orderkey AS id, round(1 - a, 6) AS n, round(a * b, 6) AS both_, round(a + b - a * b, 6) AS either_, round(least(greatest(b * a / 0.7, 0), 1), 6) AS after, round(least(a * 0.5, 1), 6) AS standing FROM (SELECT o_orderkey, o_orderkey % 11 / 10.0 AS a, o_orderkey % 7 / 7.0 AS b FROM orders)")
def probabilities(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 11 / 10.0).cast("double").alias("a"), (F.col("o_orderkey") % 7 / 7.0).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    cols = {"n": prob.complement(a), "both_": prob.both(a, b), "either_": prob.either(a, b), "after": prob.bayes(a, b, F.lit(0.7)), "standing": prob.credibility(a, F.lit(None).cast("double"), F.lit(0), F.lit(0))}
    return o.select("id", *(F.round(c, 6).alias(k) for k, c in cols.items()))


@query("SELECT user_id AS fact_id, round(list_reduce(list_prepend(0.5::double, list(d ORDER BY event_id)), lambda w, x: CASE WHEN x > 0 THEN w + (1 - w) * 0.1 * x ELSE w + w * 0.15 * x END), 6) AS weight FROM (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 0.5::double ELSE -0.25::double END AS d FROM events) GROUP BY 1")
def voted_weights(spark, sf):
    e = _table(spark, sf, "events")
    good = F.col("event_type") == "click"
    votes = e.select(F.col("user_id").alias("fact_id"), F.col("event_id").alias("ts"), F.when(good, "support").otherwise("refute").alias("kind"), F.when(good, 0.5).otherwise(0.25).alias("strength"))
    return reconcile.voted(e.select(F.col("user_id").alias("fact_id"), F.lit(0.5).alias("weight")).distinct(), votes).select("fact_id", F.round("weight", 6).alias("weight"))


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(x, '^[0-9]') OR x = '' THEN '_' || x ELSE x END AS identifier FROM (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS x FROM part)")
def identifiers(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.identifier(F.col("p_brand")).alias("identifier"))


@query("SELECT p_partkey AS id, CASE WHEN n = 1 THEN k ELSE k || '_' || n END AS unique_name FROM (SELECT p_partkey, k, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS n FROM (SELECT p_partkey, trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM part))")
def unique_names(spark, sf):
    return ingest.unique_names(_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand", "id").select("id", "unique_name")


# Ingestion, versions, streams -------------------------------------------------------------------
@query("SELECT conv_id, turn, list_filter(['user', 'assistant', 'er', 'ion'], lambda t: contains(lower(text), t)) AS terms FROM conversations WHERE len(list_filter(['user', 'assistant', 'er', 'ion'], lambda t: contains(lower(text), t))) > 0")
def technical_turns(spark, sf):
    return ingest.technical_turns(_table(spark, sf, "conversations"), ("user", "assistant", "er", "ion")).select("conv_id", "turn", "terms")


@query("SELECT 'likes' AS rel, 'Customer' AS source_type, CASE WHEN count(DISTINCT o_orderstatus) > 0 THEN 'Entity' END AS target_type, false AS functional FROM orders")
def drafted_schema(spark, sf):
    o = _table(spark, sf, "orders")
    kinds = o.select(F.concat(F.lit("c"), "o_custkey").alias("external_id"), F.lit("Customer").alias("type")).distinct().unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("external_id"), F.concat(F.lit("Order"), "o_orderstatus").alias("type")))
    rel = o.select(F.lit("likes").alias("rel"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"))
    return ingest.draft_schema(kinds, rel, True).select("rel", "source_type", "target_type", "functional")


@query("SELECT event_id AS version FROM events e JOIN (SELECT user_id, max(CASE WHEN event_id <= 700 THEN event_id END) AS last FROM events GROUP BY 1) l USING (user_id) WHERE last IS NULL OR event_id >= last")
def garbage_collected(spark, sf):
    e = _table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"))
    return store.collect_garbage(e, 700).select("version")


@query("SELECT event_id AS fact_id, CASE WHEN value < 50 THEN 'integrated' ELSE 'rejected' END AS status FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'done' FROM events WHERE event_id % 2 = 1")
def reviewed(spark, sf):
    e = _table(spark, sf, "events")
    queue = e.select(F.col("event_id").alias("fact_id"), F.when(F.col("event_id") % 2 == 0, "review").otherwise("done").alias("status"))
    return stream.review(queue, e.select(F.col("event_id").alias("fact_id"), F.when(F.col("value") < 50, "approve").otherwise("reject").alias("action")))


@query("SELECT 'c' || c_custkey AS subject, 'is_a' AS rel, c_mktsegment AS object, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN 'conflict' WHEN c_acctbal >= 1000 THEN 'integrate' ELSE 'review' END AS decision FROM customer")
def synced_turns(spark, sf):
    c = _table(spark, sf, "customer").withColumn("subject", F.concat(F.lit("c"), "c_custkey"))
    facts = c.select("subject", F.lit("is_a").alias("rel"), F.col("c_mktsegment").alias("object"), F.when(F.col("c_acctbal") >= 1000, 0.9).otherwise(0.1).alias("confidence"))
    known = c.where("c_custkey % 3 = 0").select("subject", F.lit("is_a").alias("rel"), F.lit("BUILDING").alias("object"))
    return stream.sync_turns(facts, known).select("subject", "rel", "object", "decision")


@query(f"WITH {_FACT} SELECT count(*) AS added FROM fact WHERE line = 1")
def snapshot_changes(spark, sf):
    w = star_graph(spark, sf).wide["LineItem"]
    return algebra.snapshot_diff(w.where("line <> 1"), w).agg(F.count("*").alias("added"))


@query("SELECT 'lies' AS arrow, 'c' || c_custkey AS src, 'r' || n_regionkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pulled_back(spark, sf):
    """Customers straight in regions: the arrow of a smaller schema is a path of two in the larger one."""
    c, n = _table(spark, sf, "customer"), _table(spark, sf, "nation")
    obj = c.selectExpr("'Customer' as obj", "concat('c', c_custkey) as elem").unionByName(n.selectExpr("'Region' as obj", "concat('r', n_regionkey) as elem").distinct())
    arr = c.selectExpr("'in' as arrow", "concat('c', c_custkey) as src", "concat('n', c_nationkey) as dst").unionByName(n.selectExpr("'of' as arrow", "concat('n', n_nationkey) as src", "concat('r', n_regionkey) as dst"))
    larger = migrate.Morphism({"Person": "Client", "Place": "Area"}, {"lies": ("home",)}).then(migrate.Morphism({"Client": "Customer", "Area": "Region"}, {"home": ("in", "of")}))
    return migrate.pullback(larger, {"lies": ("Person", "Place")}, obj, arr)[1]


@query()
def vector_cells(spark, sf):
    """Approximate neighbours of every id divisible by 100; tests measure the recall."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    centres = vectors.fit_centres(e)
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.search_cells(vectors.cell_index(e, centres), q, centres, 5, vectors.probes_for(e, centres, 5))
