"""A composable algebra of sets of entities, compiled to one column of ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import paths
from graphloom.snapshot import Graph


@dataclass(frozen=True)
class SelectByType:
    type: str


@dataclass(frozen=True)
class SelectRelated:
    source: int
    rel: str


@dataclass(frozen=True)
class FollowPath:
    start: int
    labels: tuple[str, ...]


@dataclass(frozen=True)
class FindPaths:
    """Entities on simple paths between two."""

    src: int
    dst: int
    max_depth: int = 5


@dataclass(frozen=True)
class Join:
    a: object
    b: object


@dataclass(frozen=True)
class Union:
    a: object
    b: object


@dataclass(frozen=True)
class Difference:
    a: object
    b: object


@dataclass(frozen=True)
class WithConfidence:
    """Nested thresholds take the largest."""

    inner: object
    min_conf: float


def execute(graph: Graph, q, min_conf: float | None = None, trace: list[str] | None = None) -> DataFrame:
    """id of the entities of an expression; trace, if given, takes a line for each node in the order of evaluation."""
    if trace is not None:
        trace.append(type(q).__name__)
    go = lambda x: execute(graph, x, min_conf, trace)
    if isinstance(q, SelectByType):
        return graph.types.where(F.col("type") == q.type).select("id").distinct()
    if isinstance(q, SelectRelated):
        return paths.neighbours(graph, q.source, q.rel, min_conf=min_conf)
    if isinstance(q, FollowPath):
        return paths.follow(graph, q.start, list(q.labels), min_conf)
    if isinstance(q, FindPaths):
        return paths.simple_paths(graph, q.src, q.dst, q.max_depth, min_conf).select(F.explode("nodes").alias("id")).distinct()
    if isinstance(q, Join):
        return go(q.a).intersect(go(q.b))
    if isinstance(q, Union):
        return go(q.a).union(go(q.b)).distinct()
    if isinstance(q, Difference):
        return go(q.a).subtract(go(q.b))
    if isinstance(q, WithConfidence):
        return execute(graph, q.inner, max(q.min_conf, min_conf or 0.0), trace)
    raise TypeError(f"no such expression: {q!r}")


def context_diff(graph: Graph, a: int, b: int, relation: str | None = None) -> DataFrame:
    """fact_id, side ('both', 'only_a' or 'only_b') of two contexts' facts."""
    fa, fb = graph.fact_nodes(relation, ctx=a), graph.fact_nodes(relation, ctx=b)
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(fa.intersect(fb), "both").unionByName(side(fa.subtract(fb), "only_a")).unionByName(side(fb.subtract(fa), "only_b"))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def hybrid(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Hits (id, score) that a query also finds, with their scores."""
    return hits.join(ids.toDF("id").distinct(), "id", "left_semi")
