"""Traversal: fixed paths, neighbourhoods, path enumeration, best and top-k paths."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans import rpq
from graphloom.plans.fixpoint import cut
from graphloom.plans.parse_native import parse_regex
from graphloom.snapshot import Graph


def neighbours(graph: Graph, ident: int, rel: str, backward: bool = False, min_conf: float | None = None) -> DataFrame:
    """id of the entities one edge away; nothing for an unknown label."""
    e = graph.adjacency([rel], min_conf)
    near, far = ("dst", "src") if backward else ("src", "dst")
    return e.where(F.col(near) == ident).select(F.col(far).alias("id")).distinct()


def has_edge(graph: Graph, src: int, rel: str, dst: int, min_conf: float | None = None) -> bool:
    return not graph.adjacency([rel], min_conf).where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def follow(graph: Graph, start: int, labels: list[str], min_conf: float | None = None) -> DataFrame:
    """id of what a chain of labels reaches; an empty chain reaches its start."""
    out = graph.spark.createDataFrame([(start,)], "id bigint")
    for label in labels:
        out = graph.adjacency([label], min_conf).join(out.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return out


def follow_expression(graph: Graph, start: int, expression: str, max_hops: int | None = None) -> DataFrame:
    return rpq.reachable(graph, start, parse_regex(expression), max_hops)


def path_index(graph: Graph, depth: int = 3, rels: list[str] | None = None) -> DataFrame:
    """signature, src, dst of every label word of at most `depth` labels; a table to keep and probe."""
    step = graph.adjacency(rels).select(F.col("rel"), "src", "dst")
    layer = step.select(F.col("rel").alias("signature"), "src", "dst")
    out = layer
    for _ in range(depth - 1):
        layer = cut(layer.withColumnRenamed("dst", "mid").join(step.withColumnRenamed("src", "mid"), "mid").select(F.concat_ws("/", "signature", "rel").alias("signature"), "src", "dst").distinct())
        out = out.unionByName(layer)
    return out


def probe(index: DataFrame, labels: list[str], src: int | None = None, dst: int | None = None) -> DataFrame:
    out = index.where(F.col("signature") == "/".join(labels))
    if src is not None:
        out = out.where(F.col("src") == src)
    return out if dst is None else out.where(F.col("dst") == dst)


def neighbourhood(graph: Graph, starts: DataFrame, hops: int, direction: str = "both", max_nodes: int | None = None, max_edges: int | None = None, rels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of what lies within some hops of starts (one column of ids), and the edges among it."""
    e = graph.edges_of(rels)
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    step = None
    for a, b in ways:
        part = e.select(F.col(a).alias("id"), F.col(b).alias("to"))
        step = part if step is None else step.unionByName(part)
    seen = frontier = starts.toDF("id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, hops + 1):
        frontier = cut(frontier.join(step, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    if max_nodes is not None:
        seen = seen.orderBy("depth", "id").limit(max_nodes)
    inside = seen.select("id")
    own = e.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return seen, own if max_edges is None else own.orderBy("edge_id").limit(max_edges)


def simple_paths(graph: Graph, src: int, dst: int | None, max_length: int, min_conf: float | None = None, rels: list[str] | None = None) -> DataFrame:
    """labels, nodes, edges, confidence, length of every simple path; complete, unlike a search that marks nodes for good."""
    best = graph.best_edges(min_conf, rels)
    step = best.select(F.col("src").alias("at"), "rel", F.col("dst").alias("to"), "edge_id", "confidence")
    layer = step.where(F.col("at") == src).where("to <> at").select(F.array("rel").alias("labels"), F.array("at", "to").alias("nodes"), F.array("edge_id").alias("edges"), F.col("confidence").cast("double").alias("confidence"), F.col("to").alias("at"))
    out = layer
    for _ in range(max_length - 1):
        # A path that has reached its end goes no further: nodes may not repeat.
        grow = layer if dst is None else layer.where(F.col("at") != dst)
        layer = grow.withColumnRenamed("confidence", "so_far").join(step, "at").where(~F.array_contains("nodes", F.col("to"))).select(
            F.concat("labels", F.array("rel")).alias("labels"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"), (F.col("so_far") * F.col("confidence")).alias("confidence"), F.col("to").alias("at")
        )
        out = out.unionByName(layer)
    out = out if dst is None else out.where(F.col("at") == dst)
    return out.select("labels", "nodes", "edges", "confidence", F.size("edges").alias("length"))


def best_path(graph: Graph, src: int, dst: int, max_length: int = 5, rels: list[str] | None = None) -> DataFrame:
    """The simple path of the greatest product of confidences; shorter, then by nodes, among equals."""
    return simple_paths(graph, src, dst, max_length, rels=rels).orderBy(F.desc("confidence"), "length", "nodes").limit(1)


def best_confidences(graph: Graph, src: int, rounds: int | None = None, rels: list[str] | None = None) -> DataFrame:
    """id, confidence: the best product over all paths, or those of at most `rounds` edges, by relaxation, a maximum per node and round.

    It settles, as confidences are 1 at most and a way round a cycle never gains.
    """
    e = graph.best_edges(rels=rels)
    step = e.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("confidence").cast("double").alias("c"))
    best = graph.spark.createDataFrame([(src, 1.0)], "id bigint, confidence double")
    for _ in itertools.count() if rounds is None else range(rounds):
        grown = best.join(step, "id").select(F.col("to").alias("id"), (F.col("confidence") * F.col("c")).alias("confidence"))
        new = cut(best.unionByName(grown).groupBy("id").agg(F.max("confidence").alias("confidence")))
        if new.exceptAll(best).isEmpty():
            return new
        best = new
    return best


def top_paths(graph: Graph, src: int, dst: int, k: int, max_length: int = 5, beam: int = 64) -> DataFrame:
    """k best simple paths by beam search: each round keeps the `beam` best partial paths."""
    step = graph.best_edges().select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("confidence").cast("double").alias("c"))
    layer = graph.spark.createDataFrame([([src], 1.0, src)], "nodes array<bigint>, confidence double, at bigint")
    out = layer.where(F.lit(False))
    for _ in range(max_length):
        layer = layer.where(F.col("at") != dst).join(step, "at").where(~F.array_contains("nodes", F.col("to"))).select(F.concat("nodes", F.array("to")).alias("nodes"), (F.col("confidence") * F.col("c")).alias("confidence"), F.col("to").alias("at"))
        layer = cut(layer.orderBy(F.desc("confidence"), "nodes").limit(beam))
        out = out.unionByName(layer.where(F.col("at") == dst))
    return out.select("nodes", "confidence").orderBy(F.desc("confidence"), "nodes").limit(k)


def path_conflicts(paths: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs of a few paths (nodes, confidence) whose confidences lie apart."""
    a, b = paths.select(F.col("nodes").alias("nodes_a"), F.col("confidence").alias("a")), paths.select(F.col("nodes").alias("nodes_b"), F.col("confidence").alias("b"))
    return a.join(b, F.col("nodes_a") < F.col("nodes_b")).where(F.abs(F.col("a") - F.col("b")) > threshold)


def compose(a: list[int], b: list[int]) -> list[int]:
    """Two paths as lists of nodes, end to end."""
    if a and b and a[-1] != b[0]:
        raise ValueError("the second path does not begin where the first one ends")
    return [*a, *b[1:]] if a else b


def is_cycle(path: list[int]) -> bool:
    return len(path) > 1 and path[0] == path[-1]


def ranked_edges(graph: Graph) -> DataFrame:
    """Parallel edges with their rank by confidence."""
    w = Window.partitionBy("src", "rel", "dst").orderBy(F.desc("confidence"), "edge_id")
    return graph.edges.withColumn("rank", F.row_number().over(w))


def to_dot(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> str:
    """A bounded neighbourhood as DOT text."""
    out = ["digraph g {"]
    out += [f'  n{r.id} [label="{r.id}"];' for r in nodes.orderBy("id").limit(limit).collect()]
    out += [f'  n{r.src} -> n{r.dst} [label="{r.rel}"];' for r in edges.orderBy("edge_id").limit(limit).collect()]
    return "\n".join([*out, "}"])
