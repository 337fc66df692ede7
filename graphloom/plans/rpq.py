"""Regular path queries: an expression as an automaton, run over all sources at once.

State and node are advanced together, a round for each hop: the frontier is joined with the
edges and the automaton's few transitions, what was met before is left out, and the loop
ends when nothing is new. Each (source, node, state) is met once, at its least depth.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.ast import Alt, Label, Opt, Plus, Seq, Star, chain_of, labels_of, reverse
from graphloom.plans.fixpoint import cut, dealt
from graphloom.snapshot import Graph


class Automaton:
    """Transitions (state, label, state) without empty moves, start states and accepting states."""

    def __init__(self, regex):
        self.n, self.moves, self.empty = 0, [], {}
        first, last = self._build(regex)
        reach = {s: self._closure(s) for s in range(self.n)}
        self.starts = reach[first]
        self.accepting = {s for s in range(self.n) if last in reach[s]}
        self.transitions = sorted({(s, label, t) for s in range(self.n) for m in reach[s] for (a, label, t) in self.moves if a == m})
        # Only states that something leads to, and that lead on, matter.
        targets = {t for _, _, t in self.transitions}
        self.transitions = [x for x in self.transitions if x[0] in targets or x[0] == first]
        self.first = first
        self.accepts_empty = first in self.accepting

    def _new(self) -> int:
        self.n += 1
        return self.n - 1

    def _eps(self, a: int, b: int) -> None:
        self.empty.setdefault(a, set()).add(b)

    def _closure(self, s: int) -> set[int]:
        out, todo = {s}, [s]
        while todo:
            for t in self.empty.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def _build(self, r) -> tuple[int, int]:
        a, b = self._new(), self._new()
        if isinstance(r, Label):
            self.moves.append((a, r.name, b))
        elif isinstance(r, Seq):
            at = a
            for p in r.parts:
                x, y = self._build(p)
                self._eps(at, x)
                at = y
            self._eps(at, b)
        elif isinstance(r, Alt):
            for p in r.parts:
                x, y = self._build(p)
                self._eps(a, x)
                self._eps(y, b)
        else:
            x, y = self._build(r.inner)
            self._eps(a, x)
            self._eps(y, b)
            if isinstance(r, (Star, Opt)):
                self._eps(a, b)
            if isinstance(r, (Star, Plus)):
                self._eps(y, x)
        return a, b


#: Chains that an expression may stand for to be run as their union.
MOST_WORDS = 8


def _words(regex) -> set[tuple[str, ...]] | None:
    """The label words of an expression without repetition; None for others, or where there are too many."""
    if isinstance(regex, Label):
        return {(regex.name,)}
    if isinstance(regex, (Star, Plus)):
        return None
    if isinstance(regex, Opt):
        inner = _words(regex.inner)
        return None if inner is None else inner | {()}
    out = {()} if isinstance(regex, Seq) else set()
    for part in regex.parts:
        own = _words(part)
        if own is None or len(out) * len(own) > MOST_WORDS:
            return None
        out = {a + b for a in out for b in own} if isinstance(regex, Seq) else out | own
    return out


def pairs(graph: Graph, regex, sources: DataFrame | None = None, max_hops: int | None = None, min_conf: float | None = None, strict_max_hops: bool = False) -> DataFrame:
    """Distinct (src, dst) for which a path's labels match.

    sources: one column of ids to start from (all entities if None). A bound on the hops
    holds for expressions that are more than a chain of labels, and for chains too if it
    is strict.
    """
    chain = chain_of(regex)
    if chain is not None and strict_max_hops and max_hops is not None and len(chain) > max_hops:
        chain_sources = sources if sources is not None else graph.entities.select("id")
        return chain_sources.limit(0).toDF("src").withColumn("dst", F.col("src"))
    if chain is not None:
        out = None
        for label in chain:
            e = graph.adjacency([label], min_conf).select("src", "dst")
            if out is None:
                out = e if sources is None else e.join(sources.toDF("src"), "src", "left_semi")
            else:
                out = out.withColumnRenamed("dst", "mid").join(e.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        return out
    words = _words(regex)
    if words is not None and len(words) <= MOST_WORDS:
        # A choice among few chains is their union: nothing is met twice, so nothing has to be remembered.
        start = (sources if sources is not None else graph.entities.select("id")).toDF("src")
        found = []
        for word in sorted(w for w in words if max_hops is None or len(w) <= max_hops):
            out = start.select("src", F.col("src").alias("dst")) if not word else None
            for k, label in enumerate(word):
                e = graph.adjacency([label], min_conf).select("src", "dst")
                out = dealt(e, "src", rows=graph.edges_of([label]).count()).join(start, "src", "left_semi") if not k else out.withColumnRenamed("dst", "mid").join(e.withColumnRenamed("src", "mid"), "mid").select("src", "dst")
            found.append(out)
        return dealt(reduce(DataFrame.unionByName, found), "src", "dst", rows=graph.edges_of(sorted(labels_of(regex))).count()).distinct() if found else start.limit(0).withColumn("dst", F.col("src"))
    nfa = Automaton(regex)
    edges = graph.adjacency(sorted(labels_of(regex)), min_conf)
    start = (sources if sources is not None else graph.entities.select("id")).toDF("src").distinct()
    flat = graph.spark.createDataFrame(nfa.transitions, "state int, rel string, state2 int")  # a row for each move of the expression
    steps = cut(edges.join(F.broadcast(flat), "rel").select("state", F.col("src").alias("node"), "state2", F.col("dst").alias("node2")).distinct())
    seen = frontier = cut(start.select("src", F.col("src").alias("node"), F.lit(nfa.first).alias("state")))
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = frontier.join(steps, ["node", "state"]).select("src", F.col("node2").alias("node"), F.col("state2").alias("state")).distinct()
        frontier = cut(step.join(seen, ["src", "node", "state"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hops % 8 == 0:
            seen = cut(seen)
    accepted = seen.where(F.col("state").isin(sorted(nfa.accepting))).select("src", F.col("node").alias("dst"))
    return accepted.distinct()


def reachable(graph: Graph, start: int, regex, max_hops: int | None = None, min_conf: float | None = None, backward: bool = False) -> DataFrame:
    """id of every entity that a matching path from `start` (or to it, if backward) reaches."""
    one = graph.spark.createDataFrame([(start,)], "id bigint")
    if backward:
        return backward_pairs(graph, regex, one, max_hops, min_conf).select(F.col("src").alias("id"))
    return pairs(graph, regex, one, max_hops, min_conf).select(F.col("dst").alias("id"))


def backward_pairs(graph: Graph, regex, targets: DataFrame, max_hops: int | None = None, min_conf: float | None = None, strict_max_hops: bool = False) -> DataFrame:
    """pairs() found from the far end: the expression read backwards over turned edges."""
    turned = flipped(graph)
    return pairs(turned, reverse(regex), targets, max_hops, min_conf, strict_max_hops).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def flipped(graph: Graph) -> Graph:
    turn = lambda e: e.select("edge_id", "rel", F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")
    e = graph.labels()
    return graph.changed(edges=turn(graph.edges) if e is None else e.mapped(turn))


def witnesses(graph: Graph, regex, start: int, target: int, max_hops: int | None = None, min_conf: float | None = None) -> list[int] | None:
    """Edge ids of a shortest matching path from start to target, of any length or of max_hops edges at most; None where there is none."""
    nfa = Automaton(regex)
    best = graph.best_edges(min_conf, sorted(labels_of(regex)))
    flat = graph.spark.createDataFrame(nfa.transitions, "state int, rel string, state2 int")
    steps = cut(best.join(F.broadcast(flat), "rel").select("state", F.col("src").alias("node"), "state2", F.col("dst").alias("node2"), "edge_id"))
    if start == target and nfa.accepts_empty:
        return []
    seen = frontier = cut(graph.spark.createDataFrame([(start, nfa.first, [])], "node bigint, state int, path array<bigint>"))
    for _ in itertools.count() if max_hops is None else range(max_hops):
        step = frontier.join(steps, ["node", "state"]).select(F.col("node2").alias("node"), F.col("state2").alias("state"), F.concat("path", F.array("edge_id")).alias("path"))
        frontier = cut(step.groupBy("node", "state").agg(F.min("path").alias("path")).join(seen.select("node", "state"), ["node", "state"], "left_anti"))
        hit = frontier.where((F.col("node") == target) & F.col("state").isin(sorted(nfa.accepting))).agg(F.min("path")).first()[0]
        if hit is not None:
            return list(hit)
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
    return None
