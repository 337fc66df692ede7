"""The query languages over small graphs with answers worked out by hand, and random ones against a naive search."""

import random

import pytest

from graphloom.plans import rpq, surfaces
from graphloom.plans.ast import Alt, Label, Opt, Plus, QueryError, Seq, Star, show_regex
from graphloom.plans.elaborate import canonical_paths, expand
from graphloom.plans.parse_native import parse_query, parse_regex
from graphloom.session import GraphSession
from graphloom.snapshot import Constraint, Graph, Meta, RewriteRule


@pytest.fixture(scope="module")
def tiny(spark):
    """Three nodes in a row."""
    return GraphSession(Graph.of(spark, entities=[(0, "Spot", "a"), (1, "Spot", "b"), (2, "Spot", "c")], edges=[(0, "step", 0, 1, 0.9), (1, "leap", 1, 2, 0.9), (2, "step", 0, 1, 0.5)]))


@pytest.fixture(scope="module")
def flows(spark):
    """Reified flows in two worlds, with declarations."""
    meta = Meta(frozenset(["Agent", "Firm", "World"]), (("Firm", "Agent"),), {("Eco", "Flow"): (("from", "Agent"), ("to", "Agent"), ("ctx", "World"))}, (Constraint("key", "Flow", ("from", "to")),), (RewriteRule("r", ("a", "b"), ("c",), True),))
    wide = {"Flow": spark.createDataFrame([(10, 1, 2, 5), (11, 2, 3, 6), (12, 1, 3, 6)], "fact_id bigint, `from` bigint, `to` bigint, ctx bigint")}
    g = Graph.of(
        spark, wide=wide, meta=meta, entities=[(1, "Agent", "x"), (2, "Firm", "y"), (3, "Agent", "z"), (5, "World", "W1"), (6, "World", "W2")],
        facts=[(10, "Eco", "Flow"), (11, "Eco", "Flow"), (12, "Eco", "Flow")], fact_context=[(10, 5), (11, 6), (12, 6)], edges=[(0, "Flow", 1, 2, 1.0), (1, "Flow", 2, 3, 1.0)],
    )
    return GraphSession(g)


def rows(session, text, **options):
    return sorted(tuple(r) for r in session.query(text, **options).collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("select ?y where 0 -step/leap-> ?y", [(2,)]),
        ("select ?y where 0 -[step/leap]-> ?y", [(2,)]),
        ("select ?y where 0 -step*-> ?y", [(0,), (1,)]),
        ("select ?y where 0 -(step|leap)+-> ?y", [(1,), (2,)]),
        ("select ?y where 0 -(step|leap)*-> ?y max_hops 1", [(0,), (1,)]),
        ("select ?y where 0 -step/leap-> ?y max_hops 1", [(2,)]),
        ("select ?x where ?x -step-> b", [(0,)]),
        ('select ?x where ?x -step/leap-> name("c")', [(0,)]),
        ("select ?x where ?x has step", [(0,)]),
        ('select ?x where ?x { is Spot, step, name="a" }', [(0,)]),
        ('select ?x where ?x is Spot, ?x.name = \'b\'', [(1,)]),
        ("select ?y where 0 -step-> ?y min_conf 0.6", [(1,)]),
        ("select ?y where 0 -step-> ?y min_conf 0.95", []),
        ("select ?x where ?x : Spot or ?x -step-> _", [(0,), (0,), (1,), (2,)]),
        ('select ?x where contains(?x, "name", "")', []),
        ('select ?x where fuzzy(?x, "name", "B", 0)', [(1,)]),
        ("select ?x where ?x -nothing-> ?y", []),
        ("where 0 -step-> 1", [(True,)]),
        ("where 1 -step-> 0", []),
        ("select ?x where ?x -step-> ?x", []),
        ('select ?x where attrs(?x, name="c")', [(2,)]),
    ],
)
def test_native(tiny, text, want):
    assert rows(tiny, text) == want


def test_has_multiplies_and_distinct_does_not(spark):
    s = GraphSession(Graph.of(spark, entities=[(i, "N", str(i)) for i in range(3)], edges=[(0, "r", 0, 1, 1.0), (1, "r", 0, 2, 1.0), (2, "r", 0, 2, 0.1)]))
    assert rows(s, "select ?x where ?x has r") == [(0,), (0,)]
    assert rows(s, "select ?x where ?x has r", distinct=True) == [(0,)]


def test_default_limit_and_truncation(spark):
    s = GraphSession(Graph.of(spark, entities=[(i, "N", str(i)) for i in range(30)]))
    assert s.query("select ?x where ?x : N").count() == 20
    assert s.rows("select ?x where ?x : N limit 30")[1] is False
    assert s.rows("select ?x where ?x : N limit 29")[1] is True


def test_sqlish_and_ask(tiny):
    assert rows(tiny, "SELECT y FROM Spot AS y WHERE FOLLOW(0, 'step/leap', y)", lang="sqlish") == [(2,)]
    assert rows(tiny, "SELECT x FROM Spot AS x WHERE HAS(x, 'step') AND ATTR(x, 'name') = 'a' LIMIT 5;", lang="sqlish") == [(0,)]
    assert rows(tiny, "SELECT x FROM Spot AS x WHERE FOLLOW(x, 'step', 'b')", lang="sqlish") == [(0,)]
    assert rows(tiny, "ask find Spot named b", lang="ask") == [(1,)]
    assert rows(tiny, "ask from a follow step/leap", lang="ask") == [(2,)]
    for bad in ("SELECT x FROM Spot", "SELECT x FROM Spot AS x ORDER BY x", "SELECT x FROM Spot AS x WHERE HAS(x, 'a') OR HAS(x, 'b')"):
        with pytest.raises(QueryError):
            surfaces.parse_sqlish(bad)


def test_errors(tiny, flows):
    for bad in ("select ?z where ?x : Spot", "select ?x where", "select ?x where ?x : Spot min_conf 2"):
        with pytest.raises(QueryError):
            tiny.query(bad)
    for bad in ("select ?x where ?x : Nobody", "select ?f where ?f = Flow(foo=?x)", "select ?f where ?f = Flow(from=?x) in W9"):
        with pytest.raises(QueryError):
            flows.query(bad)


def test_facts_contexts_and_types(flows):
    assert rows(flows, "select ?a ?b where Flow(from=?a, to=?b)") == [(1, 2), (1, 3), (2, 3)]
    assert rows(flows, "select ?f where ?f = Flow(from=x)") == [(10,), (12,)]
    assert rows(flows, "select ?f where ?f = Eco.Flow(from=?a) in W1") == [(10,)]
    assert rows(flows, "select ?f where ?f = Flow(to=?a) in {W1, W2}") == [(10,), (11,), (12,)]
    assert rows(flows, "select ?x where ?x : Agent") == [(1,), (2,), (3,)]
    assert rows(flows, "select ?y where 1 -Flow-> ?y in W2") == [(2,)]  # a plain edge is in every world
    assert [r.fact_id for r in flows.graph.fact_by_key("Flow", {"from": 1, "to": 3}).collect()] == [12]
    assert flows.graph.fact_by_key("Flow", {"from": 1}) is None
    assert "?_fact1" in flows.elaborate("select ?a where Flow(from=?a)")[0]


def test_round_trips():
    q = parse_query('select ?x where ?x -(a|b/c)*/d?-> name("z"), fts(?x, "k", "Foo \\"bar") or ?f = R(p=?x, q=_), fuzzy(?x, "n", "m", 2) in {C1, C2} max_hops 3 min_conf 0.5 limit 7')
    assert surfaces.from_json(surfaces.to_json(q)) == q
    assert parse_query(surfaces.to_text(q)) == q
    assert surfaces.digest(q) == surfaces.digest(surfaces.from_json(surfaces.to_json(q)))


def test_rewrite_rules_read_both_ways_only():
    rule = RewriteRule("r", ("a", "b"), ("c",), True)
    atoms = expand(parse_query("select ?x where ?x -a/b-> ?y").disjuncts[0])
    assert canonical_paths(atoms, Meta(rules=(rule,)))[0].path == Label("c")
    assert canonical_paths(atoms, Meta(rules=(RewriteRule("r", ("a", "b"), ("c",), False),)))[0].path == parse_regex("a/b")


def naive(edges, regex, nodes):
    """Pairs by the meaning of the expression, on sets."""
    if isinstance(regex, Label):
        return {(a, b) for r, a, b in edges if r == regex.name}
    if isinstance(regex, Seq):
        out = naive(edges, regex.parts[0], nodes)
        for p in regex.parts[1:]:
            step = naive(edges, p, nodes)
            out = {(a, d) for a, b in out for c, d in step if b == c}
        return out
    if isinstance(regex, Alt):
        return set().union(*(naive(edges, p, nodes) for p in regex.parts))
    own = naive(edges, regex.inner, nodes)
    if isinstance(regex, Opt):
        return own | {(n, n) for n in nodes}
    out = set(own)
    while True:
        more = out | {(a, d) for a, b in out for c, d in own if b == c}
        if more == out:
            return out | ({(n, n) for n in nodes} if isinstance(regex, Star) else set())
        out = more


def random_regex(r, depth=3):
    kind = r.choice("lllsao*+") if depth else "l"
    sub = lambda: random_regex(r, depth - 1)
    if kind == "l":
        return Label(r.choice("abc"))
    if kind in "sa":
        return (Seq if kind == "s" else Alt)((sub(), sub()))
    return {"o": Opt, "*": Star, "+": Plus}[kind](sub())


@pytest.mark.parametrize("seed", range(6))
def test_paths_against_naive_search(spark, seed):
    r = random.Random(seed)
    nodes = list(range(r.randrange(2, 9)))
    edges = [(r.choice("abc"), r.choice(nodes), r.choice(nodes)) for _ in range(r.randrange(1, 16))]
    g = Graph.of(spark, entities=[(n, "N", str(n)) for n in nodes], edges=[(i, a, b, c, 1.0) for i, (a, b, c) in enumerate(edges)])
    regex = random_regex(r)
    want = naive(edges, regex, nodes)
    assert parse_regex(show_regex(regex)) is not None
    assert naive(edges, parse_regex(show_regex(regex)), nodes) == want
    got = {tuple(x) for x in rpq.pairs(g, regex).select("src", "dst").collect()}
    assert got == want
    one = spark.createDataFrame([(nodes[0],)], "id bigint")
    assert {tuple(x) for x in rpq.backward_pairs(g, regex, one).select("src", "dst").collect()} == {p for p in want if p[1] == nodes[0]}
    path = rpq.witnesses(g, regex, nodes[0], nodes[-1]) if nodes[0] != nodes[-1] else None
    assert (path is not None) == ((nodes[0], nodes[-1]) in want and nodes[0] != nodes[-1])
