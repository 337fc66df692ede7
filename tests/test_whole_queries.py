"""Registered queries against brute force over all rows of their tables."""

import duckdb
import numpy as np
import pytest

from graphloom.catalogue import ORACLE_SQL, QUERIES
from graphloom.operators import retrieve
from graphloom.snapshot import chain_graph, star_graph

SF = "/root/testdata/sf0.001"


def test_path_index_has_all_labels_and_sources(spark):
    steps = {}
    for r in star_graph(spark, SF).edges.select("rel", "src", "dst").distinct().collect():
        steps.setdefault(r.src, set()).add((r.rel, r.dst))
    want = {(rel, a, b) for a, out in steps.items() for rel, b in out}
    want |= {(f"{rel}/{more}", a, c) for a, out in steps.items() for rel, b in out for more, c in steps.get(b, ())}
    rows = [tuple(r) for r in QUERIES["path_index"](spark, SF).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    with duckdb.connect() as db:
        for t in ("supplier", "nation"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert set(db.execute(ORACLE_SQL["path_index"]).fetchall()) < want


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-round(float(np.dot(vectors[q], v)), 9) + 0.0, i) for i, v in vectors.items() if i != q)
        out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_token_hash_search_asks_for_every_hundredth_id(spark):
    texts = chain_graph(spark, SF).attrs.where("key = 'text'").select("id", retrieve.token_hash("value").alias("v")).collect()
    vectors = {r.id: np.array(r.v) for r in texts}
    want = brute_nearest(vectors, [i for i in vectors if i % 100 == 0], 12)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in QUERIES["token_hash_search"](spark, SF).collect()}
    assert len({q for q, _ in got}) > 1 and got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-9) for x in want)


def test_blocks_of_queries_with_ties(spark):
    r = np.random.default_rng(3)
    vectors = {i: r.integers(-1, 2, 4).astype(float) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, vector array<double>")
    q = df.where("id % 7 = 0").selectExpr("id as query_id", "vector as query")
    got = {(x.query_id, x["rank"]): (x.id, x.score) for x in retrieve.top_k_blocks(df, q, 5, block=10).collect()}
    assert got == brute_nearest(vectors, [i for i in vectors if i % 7 == 0], 5)
