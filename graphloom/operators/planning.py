"""Proposals for new facts, their preview, and choosing among plans by cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analytics import guardrail_cost
from graphloom.operators.constraints import quality_delta, quality_report
from graphloom.snapshot import Graph

PROPOSAL = ["proposal_id", "rel", "source", "target", "confidence"]


def propose_relations(rel: str, sources: DataFrame, targets: DataFrame, pairing: str = "zip", confidence: float = 0.5) -> DataFrame:
    """proposal_id, rel, source, target, confidence between two small lists (name): in step, or each with each."""
    a, b = sources.select(F.col("name").alias("source")), targets.select(F.col("name").alias("target"))
    if pairing == "zip":
        n = lambda df, c: df.groupBy().agg(F.array_sort(F.collect_list(c)).alias("v")).select(F.posexplode("v").alias("n", c))
        j = n(a, "source").join(n(b, "target"), "n").drop("n")
    else:
        j = a.crossJoin(b)
    return j.select(F.sha2(F.concat_ws("|", F.lit(rel), "source", "target"), 256).alias("proposal_id"), F.lit(rel).alias("rel"), "source", "target", F.lit(confidence).alias("confidence"))


def propose_facts(relation: str, rows: DataFrame, confidence: float = 0.5) -> DataFrame:
    """A proposal for each row of named fields: proposal_id, relation, fields (map), confidence."""
    pairs = F.map_from_arrays(F.array(*(F.lit(c) for c in rows.columns)), F.array(*(F.col(c).cast("string") for c in rows.columns)))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(relation), *(F.col(c).cast("string") for c in rows.columns)), 256).alias("proposal_id"), F.lit(relation).alias("relation"), pairs.alias("fields"), F.lit(confidence).alias("confidence"))


def preview(graph: Graph, changed: Graph) -> DataFrame:
    """What a change would do to the quality report."""
    return quality_delta(quality_report(graph), quality_report(changed))


def plan(graph: Graph, steps: list[dict], rounds: int, task_cost=None) -> list[tuple[str, float]]:
    """Greedy choice among named changes (name, apply: graph -> graph): in each round the one of least guardrail and task cost."""
    out, left = [], list(steps)
    for _ in range(rounds):
        best = None
        for s in left:
            g = s["apply"](graph)
            cost = guardrail_cost(quality_report(g)).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0] + (task_cost(g) if task_cost else 0.0)
            if best is None or cost < best[0]:
                best = (cost, s, g)
        if best is None:
            break
        out.append((best[1]["name"], best[0]))
        left.remove(best[1])
        graph = best[2]
    return out


def learning_graph(graph: Graph, relations: dict[str, tuple[str, str]]) -> DataFrame:
    """rel, src, dst of the edges whose ends have the declared types: rel -> (source type, target type)."""
    out = None
    for rel, (a, b) in sorted(relations.items()):
        e = graph.adjacency([rel]).join(graph.type_scan(a).toDF("src"), "src", "left_semi").join(graph.type_scan(b).toDF("dst"), "dst", "left_semi").select("rel", "src", "dst")
        out = e if out is None else out.unionByName(e)
    return out


def typed_entities(graph: Graph, schema: str, kind: str) -> DataFrame:
    """id of entities of a type that belong to a schema."""
    own = graph.attr_scan("in_schema", schema)
    return graph.type_scan(kind).join(own, "id", "left_semi")
