"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the least node that each node of the edges (a, b; longs) reaches; least nodes themselves are no rows.

    Each round hangs every neighbour of a node on the least of them, first the larger
    ones and then the smaller (large star, small star), until nothing moves: a number of
    rounds in the logarithm of the nodes. Each round is written to the shared folder, so
    a lost executor costs one round's work. Loops and repeated edges do no harm.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        e = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def members(found: DataFrame, name: str) -> DataFrame:
    """What components found, as `name` and root, with a row for each root as well."""
    return found.select(F.col("node").alias(name), "root").unionByName(found.select(F.col("root").alias(name), "root").distinct())
