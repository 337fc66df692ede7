"""Operators whose shuffles or memory grew faster than their input."""

import random

import pytest

from graphloom.operators import network, retrieve
from graphloom.plans import rpq
from graphloom.plans.parse_native import parse_regex
from graphloom.snapshot import Graph


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("edges", [[(1, 2), (1, 2), (2, 3), (9, 3), (3, 8)], [(1, 2), (2, 3), (3, 1), (4, 1), (4, 5), (4, 77)], []])
def test_pagerank_against_plain_rounds(spark, edges):
    ids, n = range(1, 7), 6
    rank = dict.fromkeys(ids, 1 / n)
    for _ in range(30):
        sunk = sum(r for i, r in rank.items() if all(s != i for s, _ in edges))
        rank = {i: 0.15 / n + 0.85 * (sunk / n + sum(rank.get(s, 0) / sum(x == s for x, _ in edges) for s, d in edges if d == i)) for i in ids}
    got = network.pagerank(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.id: pytest.approx(r["rank"], abs=1e-12) for r in got.collect()} == rank


def test_modularity_aggregates_pairs_of_parts(spark):
    r = random.Random(4)
    edges = [(r.randrange(9), r.randrange(9)) for _ in range(40)] + [(1, 1)]
    part = {i: i % 3 for i in range(9)}
    used = [e for e in edges if e[0] != e[1]]
    ends = [sum((part[a] == c) + (part[b] == c) for a, b in used) for c in range(3)]
    want = sum(part[a] == part[b] for a, b in used) / len(used) - sum((d / (2 * len(used))) ** 2 for d in ends)
    got = network.modularity(spark.createDataFrame(list(part.items()), "id bigint, c bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert got.first()[0] == pytest.approx(want) and "Join" not in _plan(got)


def test_a_choice_of_chains_needs_no_rounds(spark):
    g = Graph.of(spark, entities=[(i, "N", str(i)) for i in range(4)], edges=[(0, "a", 0, 1, 1.0), (1, "b", 1, 2, 1.0), (2, "b", 0, 1, 1.0), (3, "a", 9, 1, 1.0)])
    for text, hops, want in (("a|b", None, {(0, 1), (1, 2)}), ("a/b?", None, {(0, 1), (0, 2)}), ("a/b?", 1, {(0, 1)}), ("(a/b)?", 1, {(i, i) for i in range(4)}), ("a|b", 0, set())):
        out = rpq.pairs(g, parse_regex(text), max_hops=hops)
        rows = [tuple(r) for r in out.select("src", "dst").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert "Anti" not in _plan(out) and "/cut-" not in str(out.inputFiles())


def test_nearest_vectors_move_no_scores_of_all_pairs(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "id bigint, vector array<double>")
    out = retrieve.top_k_each(v, v.where("id % 100 = 0").selectExpr("id as query_id", "vector as query"), 2)
    assert "Join" not in _plan(out) and sorted(tuple(r) for r in out.select("query_id", "id", "rank").collect()) == [(0, 1, 1), (0, 2, 2), (100, 6, 1), (100, 13, 2), (200, 6, 1), (200, 13, 2)]
