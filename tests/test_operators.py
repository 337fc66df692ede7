"""Operators on small inputs with known answers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import prob, text
from graphloom.operators import algebra, analytics, certify, constraints, migrate, modal, network, paths, planning, reconcile, retrieve
from graphloom.plans.ast import QueryError
from graphloom.plans.parse_native import parse_query
from graphloom.snapshot import Constraint, Graph, Meta
from graphloom.sources import ingest, modules
from graphloom.streaming import store, stream

MODULE = """
-- a demonstration
module Demo

schema S:
  object Person
  object Worker
  object Kind
  subtype Worker < Person
  relation Knows(from: Person, to: Person, kind: Kind)
  relation AnswersTo(junior: Person, senior: Person)
  relation Reach(from: Person, to: Person)

theory T on S:
  constraint key AnswersTo(junior, senior)
  constraint functional AnswersTo.junior -> AnswersTo.senior
  constraint symmetric Knows where
    Knows.kind in {Friend}
  constraint key Reach(from, to)
  constraint transitive Reach

instance I of S:
  Person = {Ann, Ben, Cy}
  Kind = {Friend, Mentor}
  Knows = {
    (from=Ann, to=Ben, kind=Friend),
    (from=Ben, to=Ann, kind=Mentor)
  }
  AnswersTo = {(junior=Ann, senior=Ben), (junior=Ann, senior=Ben)}
  Reach = {(from=Ann, to=Ben), (from=Ben, to=Cy)}
"""


def got(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def ring(spark):
    """0 -> 1 -> 2 -> 0, and 2 -> 3, 4 alone."""
    return Graph.of(spark, entities=[(i, "N", f"n{i}") for i in range(5)], edges=[(0, "r", 0, 1, 0.5), (1, "r", 1, 2, 0.8), (2, "r", 2, 0, 1.0), (3, "s", 2, 3, 0.25), (4, "r", 0, 1, 0.9)])


def test_network(ring):
    nodes, edges = ring.entities.select("id"), network.edge_list(ring)
    assert got(network.weak_components(nodes, edges)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
    assert got(network.strong_components(nodes, edges), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]
    assert got(network.degrees(nodes, edges)) == [(0, 2, 1, 3), (1, 1, 2, 3), (2, 2, 1, 3), (3, 0, 1, 1), (4, 0, 0, 0)]
    assert abs(network.pagerank(nodes, edges, 20).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    b = dict(got(network.betweenness(nodes, edges, 5)))
    assert b[3] == 0 and b[4] == 0 and b[2] == max(b.values()) > 0
    assert len({c for _, c in got(network.communities(nodes, edges))}) >= 2
    assert network.modularity(network.weak_components(nodes, edges), edges).first()[0] == pytest.approx(0)


def test_strong_components_of_long_chains_and_random_graphs(spark):
    """A chain of 500 nodes with a cycle in its middle, and graphs against a search from each node."""
    chain = [(i, i + 1) for i in range(499)] + [(260, 240)]
    df = lambda e: spark.createDataFrame(e, "src bigint, dst bigint")
    rows = dict(network.strong_components(spark.range(500), df(chain)).collect())
    assert rows == {i: 240 if 240 <= i <= 260 else i for i in range(500)}
    r = random.Random(5)
    for n, m in ((12, 14), (25, 40), (40, 44)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        reach = {}
        for i in range(n):
            seen, todo = {i}, [i]
            while todo:
                x = todo.pop()
                for a, b in edges:
                    if a == x and b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach[i] = seen
        want = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
        assert dict(network.strong_components(spark.range(n), df(edges)).collect()) == want


def test_communities_gain_modularity(spark):
    """Two cliques with one edge between them part; no single move of a node would gain any more."""
    cliques = [(a, b) for k in (0, 10) for a in range(k, k + 6) for b in range(a + 1, k + 6)] + [(5, 10)]
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 16), 99]], "id bigint")
    labels = dict(network.communities(nodes, spark.createDataFrame(cliques, "src bigint, dst bigint")).collect())
    assert labels == {**{i: 0 for i in range(6)}, **{i: 10 for i in range(10, 16)}, 99: 99}
    r = random.Random(2)
    edges = [(r.randrange(8), r.randrange(8)) for _ in range(25)] + [(8 + r.randrange(8), 8 + r.randrange(8)) for _ in range(25)] + [(3, 11), (4, 12)]
    edges = [(a, b) for a, b in edges if a != b]
    labels = dict(network.communities(spark.range(16), spark.createDataFrame(edges, "src bigint, dst bigint")).collect())
    k = [sum((a == i) + (b == i) for a, b in edges) for i in range(16)]

    def q(lab):
        inside = sum(lab[a] == lab[b] for a, b in edges) / len(edges)
        return inside - sum((sum(k[i] for i in range(16) if lab[i] == c) / (2 * len(edges))) ** 2 for c in set(lab.values()))

    assert all(q({**labels, i: c}) <= q(labels) + 1e-9 for i in range(16) for c in set(labels.values()))


def test_paths(ring):
    assert got(paths.follow(ring, 0, ["r", "r"])) == [(2,)]
    assert got(paths.follow(ring, 0, [])) == [(0,)]
    assert got(paths.follow(ring, 0, ["r"], 0.95)) == []
    assert got(paths.simple_paths(ring, 0, 3, 4), "nodes", "edges") == [([0, 1, 2, 3], [4, 1, 3])]
    assert paths.best_path(ring, 0, 3).first().confidence == pytest.approx(0.9 * 0.8 * 0.25)
    assert dict(got(paths.best_confidences(ring, 0)))[3] == pytest.approx(0.18)
    assert [r.nodes for r in paths.top_paths(ring, 0, 3, 2).collect()] == [[0, 1, 2, 3]]
    seen, own = paths.neighbourhood(ring, ring.spark.createDataFrame([(3,)], "id bigint"), 1)
    assert got(seen) == [(2, 1), (3, 0)] and own.count() == 1
    assert got(paths.probe(paths.path_index(ring, 2), ["r", "s"]), "src", "dst") == [(1, 3)]
    assert paths.compose([1, 2], [2, 3]) == [1, 2, 3] and paths.is_cycle([1, 2, 1])
    q = algebra.Join(algebra.FindPaths(0, 3, 4), algebra.Difference(algebra.SelectByType("N"), algebra.SelectRelated(1, "r")))
    assert got(algebra.execute(ring, q)) == [(0,), (1,), (3,)]


def test_constraints(spark):
    f = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (1, "a", "x")], "k long, s string, t string")
    assert got(constraints.key_violations(f, ["k", "t"])) == [(1, "x", 2)]
    assert got(constraints.functional_violations(f, ["s"], "t")) == [("a", 2)]
    assert got(constraints.at_most_violations(f, ["s"], "t", 1, ["k"])) == [("a", 1, 2)]
    p = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 1)], "a long, b long, fibre long")
    assert got(constraints.transitive_closure(p, "a", "b", ["fibre"])) == [(1, 2, 0), (1, 3, 0), (2, 3, 0), (3, 1, 1)]
    assert (1, 3) in got(constraints.transitive_closure(p, "a", "b")) and (1, 1) in got(constraints.transitive_closure(p, "a", "b"))
    closed = constraints.closure_compatible(p.select("a", "b"), [Constraint("key", "R", ("a", "fibre"))], {"a", "b"})
    assert closed.count() == 1  # fails closed


def test_typing_rule(spark):
    r = lambda rows, schema: spark.createDataFrame(rows, schema)
    rel = {
        "FormOn": r([("F", "M4"), ("G", "M4"), ("bad", "M5")], "form string, manifold string"), "FormDegree": r([("F", "Nat2"), ("G", "Nat3"), ("bad", "Nat2")], "form string, degree string"),
        "MetricOn": r([("g", "M4")], "metric string, manifold string"), "ManifoldDimension": r([("M4", "Nat4")], "manifold string, dim string"),
        "Star": r([("g", "F", "new"), ("g", "F", "G"), ("g", "F", "bad"), ("g", "lost", "new")], "metric string, input string, output string"),
    }
    out = got(constraints.typing_violations("depends_on_metric_and_dualizes_degree", rel, "Star"))
    assert out == [("G", "the output has another degree"), ("bad", "the output lies on another manifold"), ("new", "an input is not described")]


def test_quality(spark, ring):
    g = ring.add(edges=[(9, "r", 77, 0, 1.0)])
    assert got(constraints.quality_report(g), "code", "entity_id") == [("dangling_source", 77)]
    assert constraints.subtype_cycles(Meta(subtypes=(("a", "b"), ("b", "a"), ("c", "a")))) == ["a", "b"]
    p = spark.createDataFrame([("p1", 0.5, ["c"]), (None, 1.5, [])], "proposal_id string, confidence double, evidence array<string>")
    codes = {r.code for r in constraints.quality_report(ring, proposals=p).collect()}
    assert codes == {"proposal_missing_id", "proposal_confidence_range", "proposal_missing_evidence"}
    assert got(constraints.quality_delta(constraints.quality_report(ring), constraints.quality_report(g)), "change") == [("new",)]


def test_modules(spark):
    m = modules.parse_module(MODULE)
    assert modules.typecheck(m) == []
    g = modules.import_module(spark, m)
    assert g.wide["AnswersTo"].count() == 1  # equal tuples are one fact
    assert got(g.type_scan("Person").join(g.entities, "id"), "name") == [("Ann",), ("Ben",), ("Cy",)]
    named = {r: modules.names_of(g, r) for r in g.wide}
    assert constraints.check_constraints(named, g.meta.constraints).count() == 0
    again = modules.parse_module(modules.export_module(g, m))
    assert again.relations == m.relations and sorted(map(str, again.tuples["I", "Knows"])) == sorted(map(str, m.tuples["I", "Knows"]))
    assert [modules.parse_constraint(modules.format_constraint(c)).kind for c in g.meta.constraints] == [c.kind for c in g.meta.constraints]
    bad = MODULE.replace("(from=Ann, to=Ben), (from=Ben, to=Cy)", "(from=Ann)")
    with pytest.raises(modules.ModuleError):
        modules.import_module(spark, modules.parse_module(bad))
    assert modules.parse_constraint("wishful R thinking").kind == "unknown"


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.head() is None
    first = s.promote(MODULE)
    n = s.read().entities.count()
    second = s.commit_overlay("entities", spark.createDataFrame([(900, "Person", "Dee")], "id bigint, type string, name string"))
    assert s.read("head").entities.count() == n + 1 and s.read(first).entities.count() == n
    assert s.resolve(second[:12]) == second
    third = s.checkpoint()
    assert s.read(third).entities.count() == n + 1
    s.rollback(first)
    assert s.read().entities.count() == n
    with pytest.raises(ValueError):
        s.promote(MODULE.replace("(junior=Ann, senior=Ben), (junior=Ann, senior=Ben)", "(junior=Ann, senior=Ben), (junior=Ann, senior=Cy)"))
    src = spark.createDataFrame([(901, "Person", "Eve")], "id bigint, type string, name string")
    src.write.parquet(f"file://{tmp_path}/in")
    stream.watch_folder(s, f"file://{tmp_path}/in", "entities", f"file://{tmp_path}/cp").awaitTermination()
    assert s.read().entities.count() == n + 1


def test_text_export(spark, ring, tmp_path):
    ingest.export_text(ring, f"file://{tmp_path}/t")
    back = ingest.import_text(spark, f"file://{tmp_path}/t")
    assert got(back.edges) == got(ring.edges) and got(back.attrs) == got(ring.attrs)


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, True, None), ("b", 1, False, "y"), ("b", 3, False, "z")], "key string, version long, deleted boolean, value string")
    assert got(store.versioned_read(v, 2)) == [("b", "y")]
    assert got(store.versioned_read(v, 1)) == [("a", "x"), ("b", "y")]
    assert got(store.collect_garbage(v, 2), "key", "version") == [("a", 2), ("b", 1), ("b", 3)]


def test_modal(spark):
    w = spark.createDataFrame([(x,) for x in "abc"], "world string")
    acc = spark.createDataFrame([("r", "a", "b"), ("r", "b", "b"), ("r", "b", "a")], "rel string, w1 string, w2 string")
    p = spark.createDataFrame([("b",)], "world string")
    assert got(modal.diamond(acc, "r", p)) == [("a",), ("b",)]
    assert got(modal.box(w, acc, "r", p)) == [("a",), ("c",)]
    assert modal.frame_properties(w, acc, "r") == {"reflexive": False, "symmetric": True, "transitive": False, "serial": False, "euclidean": False}
    assert got(modal.common_knowledge(w, acc, ["r"], w)) == [("a",), ("b",), ("c",)]
    assert got(modal.forbidden(w, acc.withColumn("rel", F.lit("ideal")), p)) == [("c",)]


def test_migration(spark):
    obj = spark.createDataFrame([("P", "p"), ("C", "c"), ("K", "k")], "obj string, elem string")
    arr = spark.createDataFrame([("in", "p", "c"), ("of", "c", "k")], "arrow string, src string, dst string")
    f = migrate.Morphism({"X": "P", "Y": "K"}, {"to": ("in", "of")})
    objects, arrows = migrate.pullback(f, {"to": ("X", "Y")}, obj, arr)
    assert got(objects) == [("X", "p"), ("Y", "k")] and got(arrows) == [("to", "p", "k")]
    assert migrate.instance_errors({"to": ("X", "Y")}, objects, arrows).count() == 0
    assert got(migrate.instance_errors({"to": ("X", "Y")}, objects, arrows.limit(0))) == [("to", "p", "missing")]


def test_evidence(spark):
    f = spark.createDataFrame([(1, "s", "a", "x", 0.5, 1), (2, "s", "a", "x", 0.5, 2), (3, "s", "a", "y", 0.3, 3), (4, "t", "a", "x", 0.5, 1), (5, "t", "a", "y", 0.96, 2)], "fact_id long, subject string, attribute string, value string, weight double, arrived long")
    assert got(reconcile.reconcile(f), "subject", "value", "weight", "state") == [("s", "x", 0.75, "kept"), ("t", "y", 0.96, "replaced")]
    assert got(reconcile.conflicts(f), "a", "b") == [(1, 3), (2, 3), (4, 5)]
    votes = spark.createDataFrame([(1, 1, "support", 1.0), (1, 2, "refute", 1.0)], "fact_id long, ts long, kind string, strength double")
    w = dict(got(reconcile.voted(f.select("fact_id", "weight"), votes)))
    assert w[1] == pytest.approx(0.55 * 0.85) and w[2] == 0.5
    agg = analytics.aggregate_facts(spark.createDataFrame([(1, "d", "Steel is hard!", 0.5), (2, "d", "steel  is hard", 0.5)], "position long, domain string, statement string, confidence double"))
    assert got(agg, "statement", "n", "confidence") == [("Steel is hard!", 2, 0.75)]
    now = F.lit(datetime.datetime(2024, 1, 31))
    d = spark.createDataFrame([(1, 1.0, datetime.datetime(2024, 1, 1)), (2, 0.15, datetime.datetime(2024, 1, 1))], "fact_id long, weight double, ts timestamp")
    assert got(reconcile.decay_all(d, now, 30.0), "fact_id", "weight") == [(1, 0.5)]
    v = spark.createDataFrame([("a",), ("b",)], "var string")
    un = spark.createDataFrame([("a", 0.1, 0.9)], "var string, p0 double, p1 double")
    pw = spark.createDataFrame([("f", "a", "b", 0.8, 0.2, 0.2, 0.8)], "factor string, a string, b string, p00 double, p01 double, p10 double, p11 double")
    b = dict(got(analytics.belief_propagation(v, un, pw, 4)))
    assert b["a"] == pytest.approx(0.9) and b["b"] == pytest.approx(0.9 * 0.8 + 0.1 * 0.2)
    r = spark.createDataFrame([(0.9, 1)] * 30 + [(0.1, 0)] * 30, "confidence double, correct int")
    assert got(analytics.calibration_bins(r), "bin", "n", "accuracy") == [(1, 30, 0.0), (9, 30, 1.0)]
    a, c = analytics.platt(r, epochs=50, rate=0.5)
    assert a > 1 and c < 0
    assert spark.range(1).select(prob.fixed_product(F.array(F.lit(500000), F.lit(333333)))).first()[0] == 166666


def test_text_functions(spark):
    df = spark.createDataFrame([("GetPayment PAY the-fooBar x" + "y" * 70,)], "v string")
    assert df.select(text.tokens(F.col("v"))).first()[0] == text.tokens_literal("GetPayment PAY the-fooBar x" + "y" * 70) == ["get", "payment", "foo", "bar", "x" + "y" * 63]
    assert df.select(text.name_key(F.lit("  Foo-Bar (2) "))).first()[0] == "foo_bar_2"


def test_retrieval(spark, ring):
    s = spark.createDataFrame([(1, "the red fox"), (2, "nothing alike")], "id long, text string")
    f = spark.createDataFrame([(7, "a red fox"), (8, "red")], "id long, text string")
    out = {r.id: r for r in retrieve.grounding(s, f).collect()}
    assert out[1].score == 0.5 and out[1].grounded and out[1].evidence == [7, 8] and not out[2].grounded
    v = spark.createDataFrame([("a b c",), ("a b d",), ("",)], "t string").select(retrieve.token_hash(F.col("t")).alias("v")).collect()
    assert len(v[0].v) == 128
    c = spark.createDataFrame([("c1", "f.py", "calls foo and bar"), ("c2", "g.py", "foo")], "chunk_id string, file string, text string")
    sym = spark.createDataFrame([("foo", "f.py")], "symbol string, file string")
    assert got(retrieve.link_mentions(c, sym)) == [("f.py", "foo", 0.55, ["c1"]), ("g.py", "foo", 0.75, ["c2"])]
    w = spark.createDataFrame([("N1", "N"), ("zz", "N")], "name string, type string")
    assert got(retrieve.resolve_names(w, ring.entities), "name", "id") == [("N1", 1), ("zz", None)]


def test_ingestion(spark):
    d = spark.createDataFrame([(1, "one\n\n two \n\n\n\nthree")], "doc_id long, text string")
    assert got(ingest.text_chunks(d), "chunk_id", "text") == [("1_0", "one"), ("1_1", "two"), ("1_2", "three")]
    md = spark.createDataFrame([(1, "intro\n# A\nx\ny\n## B\nz\n")], "doc_id long, text string")
    assert {(r.title, r.text) for r in ingest.markdown_chunks(md).collect()} == {(None, "intro"), ("A", "x\ny"), ("B", "z")}
    chat = spark.createDataFrame([(1, "Ann (10:00): hello\nnoise\nBen (10:01): is it?")], "doc_id long, text string")
    assert got(ingest.chat_turns(chat), "turn", "speaker", "text") == [(0, "Ann", "hello"), (1, "Ben", "is it?")]
    meet = spark.createDataFrame([(1, "ANN: hello\nthere\nBEN: yes")], "doc_id long, text string")
    assert got(ingest.meeting_turns(meet), "speaker", "text") == [("ANN", "hello there"), ("BEN", "yes")]
    turns = spark.createDataFrame([(1, 0, "u", "why?"), (1, 1, "a", "steel")], "conv_id long, turn long, role string, text string")
    assert got(ingest.conversation_chunks(turns), "chunk_id") == [("1_1",)]
    page = spark.createDataFrame([(1, '<h1>T</h1><p>a &amp; b</p><pre>code</pre><h2>U</h2><table></table><a href="/x">l</a><script>no</script>')], "page_id long, html string")
    assert got(ingest.wiki_sections(page), "level", "title", "tables", "code_blocks") == [(1, "T", 0, ["code"]), (2, "U", 1, [])]
    assert got(ingest.page_links(page), "href") == [("/x",)]
    u = lambda h: spark.range(1).select(ingest.absolute(F.lit("http://h.org/a/b?q"), F.lit(h))).first()[0]
    assert [u(h) for h in ("c", "/c", "//x.org/y", "https://z", "#f", "mailto:a@b")] == ["http://h.org/a/c", "http://h.org/c", "http://x.org/y", "https://z", None, None]
    nt = spark.createDataFrame([('<http://a/x> <http://a/p> "lit"@en .',), ("<http://a/x> <http://a/q> <http://a/y> <http://g> .",), ("# no",)], "value string")
    assert got(ingest.ntriples(nt), "object", "is_literal") == [("http://a/y", False), ("lit", True)]
    ttl = ingest.turtle(spark, '@prefix e: <http://e/> .\ne:g { e:a a e:T ; e:p e:b , "v" . }\n')
    assert got(ttl, "subject", "object", "graph")[0] == ("http://e/a", "http://e/T", "http://e/g") and ttl.count() == 3
    ddl = ingest.parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, n VARCHAR(10) NOT NULL, o INT REFERENCES u(id), UNIQUE (n));")
    assert ddl["t"]["primary_key"] == ["id"] and ddl["t"]["foreign_keys"] == [(["o"], "u", ["id"])] and ddl["t"]["unique"] == [["n"]]
    assert ingest.json_schema_of('{"a": [{"b": 1}], "c": []}')["Root"] == {"a": "List[A]", "c": "List[Unknown]"}
    assert ingest.bibtex("@book{k,\n title = {T},\n year = \"1999\"\n}")[0] == {"kind": "book", "key": "k", "title": "T", "year": "1999"}
    assert ingest.reading_list("- Deep Work by Cal N (2016): focus")[0]["year"] == "2016"
    e = spark.createDataFrame([("x1", "N", "N1", 0.9)], "external_id string, type string, name string, confidence double")
    r = spark.createDataFrame([("rel", "x1", "x2", 0.5)], "rel string, source string, target string, confidence double")
    g = ingest.import_proposals(Graph.of(spark, entities=[(1, "N", "n1")]), e, r, 1000)
    assert g.entities.where("type = 'Entity'").count() == 1 and g.edges.first().src == 1
    facts = ingest.extract_facts(spark.createDataFrame([("c", "Cutting speed of 90 sfm; maybe", "manual")], "chunk_id string, text string, source string"))
    assert facts.first().kind == "speed"
    files = spark.createDataFrame([("a.py", "import os\nfrom x.y import z\ndef f():\n  pass\nclass G:\n  pass")], "path string, text string")
    symbols, imports = ingest.index_repository(files)
    assert got(symbols, "symbol") == [("G",), ("f",)] and got(imports, "imported") == [("os",), ("x.y",)]
    assert ingest.synthetic_graph(spark, 10, 3, 2).edges.count() == 30


def test_embeddings_values_and_reviews(spark, ring):
    v = spark.createDataFrame([("N", "n0", [3.0, 4.0]), ("N", "nobody", [1.0, 0.0])], "type string, name string, vector array<double>")
    assert got(ingest.import_embeddings(ring, v, 2), "id", "vector") == [(0, [0.6, 0.8])]
    with pytest.raises(ValueError):
        ingest.import_embeddings(ring, v, 3)
    a = ring.add(attrs=[(0, "speed", "120"), (1, "speed", "90"), (2, "speed", "fast")])
    bad = lambda **k: got(constraints.value_violations(a, "speed", **k), "id")
    assert bad(between=(100, 150)) == [(1,), (2,)] and bad(one_of=["90", "fast"]) == [(0,)] and bad(above=95) == [(1,), (2,)]
    q = spark.createDataFrame([(1, "review"), (2, "review"), (3, "integrated")], "fact_id long, status string")
    d = spark.createDataFrame([(1, "approve"), (2, "reject"), (3, "reject")], "fact_id long, action string")
    assert got(stream.review(q, d)) == [(1, "integrated"), (2, "rejected"), (3, "integrated")]
    f = spark.createDataFrame([("speed", ["spindle speed", "90", "rpm"])], "kind string, fields array<string>")
    assert ingest.facts_to_tuples(f, {"speed": ("what", "value", "unit")}).first().fields == {"what": "spindle speed", "value": "90", "unit": "rpm"}


def test_drift_and_cost(spark):
    a, b = (spark.createDataFrame(x, "k string, n long") for x in ([("x", 3), ("y", 1)], [("x", 3), ("y", 1)]))
    assert analytics.drift(a, b, "k").first().divergence == pytest.approx(0)
    assert analytics.drift(a, spark.createDataFrame([("z", 4)], "k string, n long"), "k", kind="kl").first().divergence > 0
    f, h = spark.createDataFrame([(1,), (2,)], "x long"), spark.createDataFrame([(2,), (3,), (4,)], "x long")
    r = analytics.precision_recall(f, h).first()
    assert (r.precision, round(r.recall, 3)) == (0.5, 0.333)
    p = spark.createDataFrame([(1, "T", "A b", 0.5, ["e1"], {"k": "1"}), (2, "T", "a-B", 0.7, ["e2"], {"k": "2"})], "position long, type string, name string, confidence double, evidence array<string>, attrs map<string,string>")
    merged, clashes = analytics.merge_proposals(p)
    assert got(merged, "name", "confidence", "evidence") == [("A b", 0.7, ["e1", "e2"])] and merged.first().attrs == {"k": "2"} and clashes.count() == 1


def test_certificates(spark, ring):
    q = parse_query("select ?x ?z where ?x -r/r-> ?z min_conf 0.6")
    rows = certify.certify(ring, q)
    assert got(rows, "x", "z", "witness", "proof") == [(0, 2, [4, 1], 720000), (1, 0, [1, 2], 800000), (2, 1, [2, 4], 900000)]
    assert certify.verify(ring, q, rows).count() == 0
    forged = rows.withColumn("witness", F.when(F.col("x") == 0, F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).otherwise(F.col("witness")))
    assert got(certify.verify(ring, q, forged), "x") == [(0,)]
    assert certify.verify(ring, q, rows.withColumn("proof", F.lit(999999).cast("bigint"))).count() == 3
    for bad in ('select ?x where contains(?x, "name", "n")', "select ?x where ?x -r*-> ?y", "select ?x where ?x : N or ?x -r-> ?y"):
        with pytest.raises(QueryError):
            certify.certify(ring, parse_query(bad))
    assert certify.equivalent(["a", "b", "~b", "refl"], ["a"]) and not certify.equivalent(["a"], ["~a"])


def test_planning(spark, ring):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert got(planning.propose_relations("r", names("b", "a"), names("y", "x")), "source", "target") == [("a", "x"), ("b", "y")]
    assert planning.propose_relations("r", names("a", "b"), names("x", "y"), "each").count() == 4
    assert planning.propose_facts("R", spark.createDataFrame([(1, "z")], "a long, b string")).first().fields == {"a": "1", "b": "z"}
    bad = lambda g: g.add(edges=[(50, "r", 99, 0, 1.0)])
    good = lambda g: g.add(edges=[(51, "r", 4, 0, 1.0)])
    assert got(planning.preview(ring, bad(ring)), "change", "code") == [("new", "dangling_source")]
    assert planning.plan(ring, [{"name": "bad", "apply": bad}, {"name": "good", "apply": good}], 1) == [("good", 0.0)]
    assert got(planning.learning_graph(ring, {"s": ("N", "N")})) == [("s", 2, 3)]


def test_entry_imports_without_llm(tmp_path):
    """A copy of the repository without the llm folders and the pipeline registers all other queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == sum(not (k[:2] == "op" and k[2:3].isdigit()) and k != "pipeline" for k in entry.queries())
