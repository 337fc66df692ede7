"""A query reads the tables of the labels that it names, and tables by label hold what one edge table does."""

import os

from pyspark.sql import functions as F

import graphloom.catalogue_more  # noqa: F401  registers its queries
from graphloom.catalogue import QUERIES
from graphloom.plans import rpq
from graphloom.snapshot import Graph, star_graph

SF = "/root/testdata/sf0.001"


def test_queries_of_few_labels_need_no_other_tables(spark, tmp_path):
    for t in ("customer", "supplier", "nation", "region", "part", "orders"):  # no lineitem
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    assert QUERIES["ask_follow"](spark, str(tmp_path)).count() == 1
    assert QUERIES["edge_tests"](spark, str(tmp_path)).first().there
    assert QUERIES["rpq_opt"](spark, str(tmp_path)).count() == 2 * spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert QUERIES["shortest_witness"](spark, str(tmp_path)).first().hops == 3


def test_labels_hold_what_one_edge_table_does(spark, tmp_path):
    for t in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":  # repeated rows, parallel edges of other confidence, null discounts
            df = df.unionByName(df.limit(50)).unionByName(df.limit(50).withColumn("l_linenumber", F.lit(99)).withColumn("l_discount", F.lit(None).cast("double")))
        df.unionByName(df.limit(3)).write.parquet(f"{tmp_path}/{t}.parquet")
    g = star_graph(spark, str(tmp_path))
    whole = Graph.of(spark, entities=g.entities, edges=g.edges)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert g.adjacency().count() > 1000
    for of in (g, rpq.flipped(g)):
        one = whole if of is g else rpq.flipped(whole)
        for rels in (None, ["hasPart"], ["suppliedBy", "inNation", "no such"], ["no such"]):
            assert same(of.adjacency(rels), one.adjacency(rels)) and same(of.adjacency(rels, 0.95), one.adjacency(rels, 0.95))
            assert same(of.best_edges(rels=rels), one.best_edges(rels=rels)) and same(of.best_edges(0.95, rels), one.best_edges(0.95, rels))
    more = [(1, "hasPart", 1, 2, 1.0), (2, "new", 1, 2, 1.0), (3, "new", 1, 2, 0.5)]
    assert same(g.add(edges=more).adjacency(["new", "hasPart"]), whole.add(edges=more).adjacency(["new", "hasPart"]))
