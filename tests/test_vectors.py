"""The approximate vector index against exact search."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.catalogue import QUERIES
from graphloom.operators import retrieve, vectors


def exact(e, q, k):
    unit = lambda c: retrieve.normalized(F.col(c).cast("array<double>"))
    return retrieve.top_k_blocks(e.withColumn("vector", unit("vector")), q.withColumn("query", unit("query")), k)


def test_recall_on_the_tables_is_nine_tenths(spark):
    import graphloom.catalogue_more  # noqa: F401

    for sf in ("sf0.01", "sf0.1"):
        e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
        found = QUERIES["vector_cells"](spark, f"/root/testdata/{sf}").cache()
        assert vectors.recall(found, exact(e, q, 5)) >= 0.9
        assert found.where("query_id = id").count() == 0 and found.groupBy("query_id").count().where("count <> 5").count() == 0


def test_all_cells_are_exact_and_hot_cells_are_parted(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 50)
    g = np.random.default_rng(2)
    rows = [(i, g.normal(0, 1, 6).tolist()) for i in range(200)] + [(200 + i, [1.0] + [0.0] * 5) for i in range(200)]
    e = spark.createDataFrame(rows, "id long, vector array<double>")
    q = e.where("id % 100 = 0").selectExpr("id as query_id", "vector as query")
    centres = vectors.fit_centres(e, 8)
    index = vectors.cell_index(e, centres)
    assert index.count() == 400 and index.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 120
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in vectors.search_cells(index, q, centres, 4, 8).collect()}
    want = {(r.query_id, r["rank"]): (r.id, r.score) for r in exact(e, q, 4).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-9 for x in want)
    assert vectors.search_cells(vectors.cell_index(e.limit(0), centres), q, centres, 4, 8).count() == 0
