"""Rows that carry their evidence, and a checker that trusts nothing but the tables.

A witness is the edge ids that justify a row, one list for all its edge and chain atoms,
and the product of their confidences in millionths, rounded down at each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.prob import ONE, fixed
from graphloom.plans.ast import Const, EdgeAtom, FactAtom, Label, Query, QueryError, TextAtom, Var, chain_of, vars_of
from graphloom.plans.compile import Options, compile_query
from graphloom.plans.elaborate import expand
from graphloom.plans.fixpoint import dealt
from graphloom.snapshot import Graph


def _spelled(atoms) -> tuple:
    """Atoms with every chain as single edges over variables of their own; what cannot be witnessed is an error."""
    out, n = [], 0
    for a in expand(atoms):
        if isinstance(a, TextAtom):
            raise QueryError("approximate atoms cannot be certified")
        if not isinstance(a, EdgeAtom):
            out.append(a)
            continue
        labels = chain_of(a.path)
        if labels is None:
            raise QueryError("a path that repeats or chooses is witnessed by rpq.witnesses")
        at = a.left
        for i, label in enumerate(labels):
            n += 1
            to = a.right if i == len(labels) - 1 else Var(f"_mid{n}")
            out.append(EdgeAtom(at, Label(label), to))
            at = to
    return tuple(out)


def certify(graph: Graph, q: Query) -> DataFrame:
    """All variables of a conjunctive query, with `witness` (edge ids in the order of its edges), `proof` (millionths).

    Of parallel edges the most confident one is the witness. A chain gives a row for each
    way along it. Queries over several contexts are refused, as their scope is no edge.
    """
    if len(q.disjuncts) != 1 or len(q.contexts) > 1:
        raise QueryError("one branch and one context at most can be certified")
    atoms = _spelled(q.disjuncts[0])
    names = tuple(vars_of(atoms))
    df = compile_query(graph, q.with_(select=names, disjuncts=(atoms,)), Options(limit=None, carry=True))
    ids, proof = [], F.lit(ONE).cast("bigint")
    for i in range(sum(isinstance(a, EdgeAtom) for a in atoms)):
        ids.append(F.col(f"__e{i}"))
        proof = F.floor(proof * fixed(F.col(f"__p{i}")) / ONE).cast("bigint")
    return df.select(*names, (F.array(*ids) if ids else F.array().cast("array<bigint>")).alias("witness"), proof.alias("proof"))


def verify(graph: Graph, q: Query, rows: DataFrame) -> DataFrame:
    """Rows of a certified result whose witness does not bear them out; empty if all is well.

    Only edges are looked up: each witness must exist, have the atom's label, join the
    row's entities, reach the threshold, and the proof must be their product.
    """
    atoms = [a for a in _spelled(q.disjuncts[0]) if isinstance(a, EdgeAtom)]
    end = lambda t: F.lit(t.id) if isinstance(t, Const) else F.col(t.name)
    own, ok, product = rows, F.size("witness") == len(atoms), F.lit(ONE).cast("bigint")
    for i, a in enumerate(atoms):
        e = graph.edges_of([a.path.name])
        if q.min_conf is not None:
            e = e.where(F.col("confidence") >= F.lit(q.min_conf).cast("float"))
        e = e.select(F.col("edge_id").alias("__w"), F.col("src").alias("__s"), F.col("dst").alias("__d"), fixed(F.col("confidence")).alias("__p"))
        e = dealt(e, "__w", "__s", "__d").groupBy("__w", "__s", "__d").agg(F.max("__p").alias(f"__p{i}"))
        own = own.join(e, (F.get("witness", F.lit(i)) == F.col("__w")) & (end(a.left) == F.col("__s")) & (end(a.right) == F.col("__d")), "left").drop("__w", "__s", "__d")
        product = F.floor(product * F.col(f"__p{i}") / ONE).cast("bigint")  # null where there is no such edge
    return own.where(~F.coalesce(ok & (product == F.col("proof")), F.lit(False))).select(*rows.columns)


def facts_used(q: Query) -> list[str]:
    """Relations whose facts a query reads; their rows are their own witnesses."""
    return sorted({a.relation for d in q.disjuncts for a in expand(d) if isinstance(a, FactAtom)})


def normal_path(steps: list[str]) -> list[str]:
    """A path of labels, '~' before those walked backwards, without units and neighbours that undo each other."""
    out: list[str] = []
    for s in steps:
        if s in ("", "refl"):
            continue
        if out and (out[-1] == "~" + s or "~" + out[-1] == s):
            out.pop()
        else:
            out.append(s)
    return out


def equivalent(a: list[str], b: list[str]) -> bool:
    return normal_path(a) == normal_path(b)
