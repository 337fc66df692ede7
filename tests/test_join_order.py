"""Patterns of three atoms and more are joined by estimates, and witnesses travel with their atoms."""

import re

from pyspark.sql import functions as F

from graphloom.operators import certify
from graphloom.plans.compile import Options, _cheapest, compile_query
from graphloom.plans.parse_native import parse_query
from graphloom.snapshot import Graph

def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_cycle_is_not_opened_over_its_common_value(spark):
    """bgp_cycle's tables with their sizes at 60 times sf0.1: customers and suppliers of a nation would make 2,000,000,000 rows."""
    t = lambda rows, **d: (spark.range(0).select(*(F.lit(1).cast("bigint").alias(v) for v in d)), rows, d)
    df = _cheapest([t(9e6, o=9e6, c=9e5), t(9.6e5, c=9.6e5, n=25.0), t(6e4, s=6e4, n=25.0), t(3.6e7, o=9e6, p=1.2e6), t(3.6e7, p=1.2e6, s=6e4)])
    joins = re.findall(r"Join Inner, (.*)", df._jdf.queryExecution().analyzed().toString())
    assert sorted("".join(sorted(set(re.findall(r"([a-z])#", j)))) for j in joins) == ["c", "np", "o", "s"]


def test_bag_of_a_cycle_with_constants_and_types(spark):
    edges = [("a", 1, 2), ("a", 1, 3), ("b", 2, 4), ("b", 3, 4), ("c", 4, 1), ("c", 4, 5), ("b", 2, 5), ("a", 6, 2)]
    g = Graph.of(spark, entities=[(i, "N" if i % 2 else "M", str(i)) for i in range(1, 7)], edges=[(i, r, s, d, 1.0) for i, (r, s, d) in enumerate(edges + edges[:2])])
    pick = lambda rel: {(s, d) for r, s, d in edges if r == rel}
    for text, keep in (("", lambda x, y, z: True), (", ?x : N", lambda x, y, z: x % 2), (", ?z -c-> 5", lambda x, y, z: (z, 5) in pick("c"))):
        got = sorted(tuple(r) for r in compile_query(g, parse_query(f"select ?x ?y ?z where ?x -a-> ?y, ?y -b-> ?z, ?z -c-> ?x{text}"), Options(limit=None)).collect())
        assert got == sorted((x, y, z) for x, y in pick("a") for b, z in pick("b") if b == y and (z, x) in pick("c") and keep(x, y, z))


def test_witnesses_are_carried_and_each_is_looked_up(spark):
    edges = [(1, "r", 1, 2, 0.5), (2, "r", 1, 2, 0.9), (3, "s", 2, 3, 0.5), (4, "t", 3, 4, 1.0), (4, "t", 3, 4, 1.0)]
    g, q = Graph.of(spark, entities=[(i, "N", str(i)) for i in range(1, 5)], edges=edges), parse_query("select ?x ?y where ?x -r/s-> ?y, ?y -t-> ?z")
    rows = certify.certify(g, q)
    assert _plan(rows).count("Join Inner") == 2
    first = rows.first()
    assert first.witness == [2, 3, 4] and first.proof == 450_000
    wrong = [first.asDict() | x for x in ({}, {"witness": [2, 3, 3]}, {"witness": [2, 3]}, {"witness": [9, 3, 4]}, {"proof": 1}, {"x": 2}, {"witness": [1, 3, 4], "proof": 250_000})]
    given = spark.createDataFrame([tuple(w[c] for c in rows.columns) for w in wrong], rows.schema)
    bad = certify.verify(g, q, given)
    assert "Generate" not in _plan(bad) and sorted(str(r) for r in bad.collect()) == sorted(str(r) for r in given.collect()[1:6])
