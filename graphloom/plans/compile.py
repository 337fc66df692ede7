"""From the syntax tree to a DataFrame: each atom a table over its variables, joined on what they share.

Inside an atom rows are distinct (parallel edges count once); across atoms they are not, so
a result is a bag over all variables, hidden ones too. Atoms on one variable become semi
joins, and go first; then atoms that share a variable with what is joined already. Three
or more edge and fact atoms are counted first, and the pair of least estimated result is
joined until one table is left, so a cycle is closed before it multiplies rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.plans import rpq
from graphloom.plans.ast import AttrAtom, Const, EdgeAtom, FactAtom, InIds, Query, QueryError, TextAtom, TypeAtom, Var, chain_of, terms_of, vars_of
from graphloom.plans.elaborate import canonical_paths, check_chains, expand, qualify, select_list, typecheck
from graphloom.plans.fixpoint import dealt
from graphloom.snapshot import Graph


@dataclass(frozen=True)
class Options:
    limit: int | None | str = "query"
    distinct: bool = False
    rewrite: bool = False
    strict_max_hops: bool = False
    carry: bool = False  # with each edge atom's best edge, __e0, __e1 ..., and its confidence, __p0, __p1 ...: for single labels


def contexts_of(graph: Graph, names) -> list[int]:
    """Ids of contexts; a name must belong to one entity alone."""
    out = [c for c in names if isinstance(c, int)]
    wanted = [c for c in names if not isinstance(c, int)]
    if wanted:
        rows = graph.attrs.where((F.col("key") == "name") & F.col("value").isin(wanted)).join(graph.fact_context.select(F.col("ctx_id").alias("id")).distinct(), "id", "left_semi").select("value", "id").distinct().limit(2 * len(wanted) + 1).collect()
        for w in wanted:
            ids = [r.id for r in rows if r.value == w]
            if len(ids) != 1:
                raise QueryError(f"context {w} is {'unknown' if not ids else 'ambiguous'}")
            out += ids
    return out


def _unary(graph: Graph, a) -> DataFrame:
    """id of the entities for which an atom on one term holds."""
    if isinstance(a, TypeAtom):
        return graph.type_scan(a.type)
    if isinstance(a, AttrAtom):
        return graph.attr_scan(a.key, a.value)
    if isinstance(a, InIds):
        return graph.entities.where(F.col("id").isin(list(a.ids))).select("id")
    test = {"contains": text.contains, "fts": text.has_all_tokens, "fts_any": text.has_any_token}
    value = F.col("value")
    holds = text.fuzzy(value, a.text, a.distance) if a.op == "fuzzy" else test[a.op](value, a.text)
    return graph.attrs.where((F.col("key") == a.key) & holds).select("id").distinct()


def _bind(df: DataFrame, columns: list[tuple[str, object]], more: dict[str, str] | None = None) -> DataFrame:
    """Columns by the terms they stand for: constants are filtered on, one variable twice must agree; more: others, and what to call them."""
    names: dict[str, str] = {}
    for c, t in columns:
        if isinstance(t, Const):
            df = df.where(F.col(c) == t.id)
        elif t.name in names:
            df = df.where(F.col(c) == F.col(names[t.name]))
        else:
            names[t.name] = c
    return df.select(*(F.col(c).alias(v) for v, c in (names | {n: c for c, n in (more or {}).items()}).items()))


def _edge(graph: Graph, a: EdgeAtom, bound: DataFrame | None, q: Query, opts: Options) -> DataFrame:
    """src, dst of an edge or path atom; a path starts from the end that is known."""
    if chain_of(a.path) is not None and len(chain_of(a.path)) == 1:
        return graph.adjacency(chain_of(a.path), q.min_conf).select("src", "dst")
    one = lambda i: graph.spark.createDataFrame([(i,)], "id bigint")
    known = lambda t: one(t.id) if isinstance(t, Const) else bound.select(F.col(t.name).alias("id")).distinct() if bound is not None and t.name in bound.columns else None
    left, right = known(a.left), known(a.right)
    if left is None and right is not None:
        return rpq.backward_pairs(graph, a.path, right, q.max_hops, q.min_conf, opts.strict_max_hops)
    return rpq.pairs(graph, a.path, left, q.max_hops, q.min_conf, opts.strict_max_hops)


def _single(a) -> bool:
    return isinstance(a, FactAtom) or (chain_of(a.path) is not None and len(chain_of(a.path)) == 1)


def _cheapest(parts: list[tuple[DataFrame, float, dict[str, float]]]) -> DataFrame:
    """Tables with their rows and the distinct values of each variable, joined by the least estimated result."""
    parts = list(parts)

    def size(pair) -> tuple[bool, float]:
        (_, n, d), (_, m, e) = parts[pair[0]], parts[pair[1]]
        rows = n * m
        for v in d.keys() & e.keys():
            rows /= max(d[v], e[v], 1)
        return (not d.keys() & e.keys(), rows)

    while len(parts) > 1:
        i, j = min(itertools.combinations(range(len(parts)), 2), key=size)
        rows = size((i, j))[1]
        (a, n, d), (b, m, e) = parts[i], parts[j]
        shared = [v for v in d if v in e]
        if not shared:
            df = a.crossJoin(b)
        else:
            # As many tasks as the larger side, or the result, needs.
            most = int(max(n, m, rows))
            df = (dealt(a, *shared, rows=most) if n >= m else a).join(dealt(b, *shared, rows=most) if m > n else b, shared)
        known = {v: min(d.get(v, rows), e.get(v, rows), max(rows, 1)) for v in d | e}
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [(df, rows, known)]
    return parts[0][0]


def _fact(graph: Graph, a: FactAtom, contexts: list[int] | None) -> DataFrame:
    schema, _, name = a.relation.rpartition(".")
    if name not in graph.wide:
        if graph.meta:
            raise QueryError(f"unknown relation {name}")
        return _bind(graph.facts.select(F.col("fact_id"), *(F.lit(None).cast("bigint").alias(f) for f, _ in a.fields)).limit(0), [("fact_id", a.fact), *((f, t) for f, t in a.fields)])
    df = graph.wide[name]
    if schema:
        df = df.join(graph.fact_nodes(name, schema), "fact_id", "left_semi")
    if contexts is not None:
        df = df.join(graph.fact_context.where(F.col("ctx_id").isin(contexts)).select("fact_id").distinct(), "fact_id", "left_semi")
    return _bind(df, [("fact_id", a.fact), *((f, t) for f, t in a.fields)])


def _branch(graph: Graph, atoms, select: tuple[str, ...], q: Query, contexts: list[int] | None, opts: Options) -> DataFrame:
    atoms = list(expand(atoms))
    typecheck(atoms, graph.meta)
    check_chains(atoms, graph.meta)
    if opts.rewrite:
        atoms = list(canonical_paths(atoms, graph.meta))
    if graph.meta and any(isinstance(a, EdgeAtom) and any(len(graph.meta.schemas_of(x)) > 1 for x in rpq.labels_of(a.path)) for a in atoms):
        present = {r.rel for r in graph.edges.select("rel").distinct().collect()}  # as many as there are labels
        atoms = list(qualify(atoms, graph.meta, present)[0])
    unary: dict[str, list[DataFrame]] = {}
    checks: list[DataFrame] = []
    wide: list = []
    for a in atoms:
        if isinstance(a, (EdgeAtom, FactAtom)):
            wide.append(a)
        elif isinstance(a.term, Const):
            checks.append(_unary(graph, a).where(F.col("id") == a.term.id))
        else:
            unary.setdefault(a.term.name, []).append(_unary(graph, a))

    def narrowed(df: DataFrame, names) -> DataFrame:
        for v in names:
            for u in unary.pop(v, ()):
                df = df.join(u.select(F.col("id").alias(v)), v, "left_semi")
        return df

    def alone(v: str) -> DataFrame:
        first, *rest = unary.pop(v)
        out = first.select(F.col("id").alias(v))
        for u in rest:
            out = out.join(u.select(F.col("id").alias(v)), v, "left_semi")
        return out

    df: DataFrame | None = None
    if all(map(_single, wide)) and (len(wide) > 2 or opts.carry):
        tables = []
        numbers = itertools.count()
        for a in wide:
            if isinstance(a, FactAtom):
                table = _fact(graph, a, contexts)
            elif opts.carry:
                i = next(numbers)
                table = _bind(graph.best_edges(q.min_conf, chain_of(a.path)), [("src", a.left), ("dst", a.right)], {"edge_id": f"__e{i}", "confidence": f"__p{i}"})
            else:
                table = _bind(_edge(graph, a, None, q, opts), [("src", a.left), ("dst", a.right)])
            names = [c for c in table.columns if not c.startswith("__")]
            if not table.columns:
                checks.append(table.select(F.lit(1).alias("id")).limit(1))
                continue
            counts = table.agg(F.count("*"), *(F.approx_count_distinct(v) for v in names)).first() if len(wide) > 2 else [1] * (1 + len(names))
            tables.append([table, float(counts[0]), dict(zip(names, map(float, counts[1:])))])
        for v in list(unary):
            # The least table of a variable is narrowed; the others follow by the joins.
            own = min((t for t in tables if v in t[2]), key=lambda t: t[1], default=None)
            if own is None:
                continue
            for u in unary.pop(v):
                n = u.count() if len(wide) > 2 else own[2][v]
                own[0] = dealt(own[0], v, rows=int(max(own[1], n))).join(u.select(F.col("id").alias(v)), v, "left_semi")
                own[1] *= min(1.0, n / max(own[2][v], 1))
                own[2] = {k: min(d, float(n), max(own[1], 1)) if k == v else min(d, max(own[1], 1)) for k, d in own[2].items()}
        wide = []
        df = _cheapest(tables) if tables else None
    while wide:
        # The next atom: one that touches what is bound; among them constants, facts and plain edges before paths.
        bound = set(df.columns) if df is not None else set()

        def cost(a) -> tuple:
            names = {t.name for t in terms_of(a) if isinstance(t, Var)}
            fixed = sum(isinstance(t, Const) for t in terms_of(a))
            path = isinstance(a, EdgeAtom) and (chain_of(a.path) is None or len(chain_of(a.path)) > 1)
            return (bool(bound) and not names & bound, path and not fixed and not names & (bound | set(unary)), path, -fixed, -len(names & set(unary)))

        a = min(wide, key=cost)
        wide.remove(a)
        names = [t.name for t in terms_of(a) if isinstance(t, Var)]
        if isinstance(a, FactAtom):
            table = _fact(graph, a, contexts)
        else:
            # A path starts from entities that are bound or that atoms on one term leave over.
            start = df
            for t in (a.left, a.right):
                if isinstance(t, Var) and t.name not in bound and t.name in unary and not (set(names) & bound):
                    one = alone(t.name)
                    unary[t.name] = [one.select(F.col(t.name).alias("id"))]
                    start = one
                    break
            table = _bind(_edge(graph, a, start, q, opts), [("src", a.left), ("dst", a.right)])
        if not table.columns:
            checks.append(table.select(F.lit(1).alias("id")).limit(1))
            continue
        table = narrowed(table, [v for v in table.columns if v not in bound])
        if df is None:
            df = table
        else:
            shared = [c for c in table.columns if c in bound]
            df = df.join(table, shared) if shared else df.crossJoin(table)
    for v in list(unary):
        one = alone(v)
        df = one if df is None else df.join(one, v, "left_semi") if v in df.columns else df.crossJoin(one)
    for c in checks:
        ok = c.select(F.lit(1).alias("__ok")).limit(1)
        df = ok if df is None else df.join(F.broadcast(ok), how="left_semi") if "__ok" in df.columns else df.crossJoin(F.broadcast(ok)).drop("__ok")
    if df is None:
        raise QueryError("an empty query")
    if not vars_of(atoms):
        return df.limit(1).select(F.lit(True).alias("satisfied"))
    return df.select(*(F.col(v) for v in select), *(c for c in df.columns if opts.carry and c.startswith("__")))


def compile_query(graph: Graph, q: Query, opts: Options = Options()) -> DataFrame:
    """A DataFrame with a column of ids for each selected variable.

    The limit is the query's (20 where it states none) unless opts.limit overrides it; None
    lifts it. Branches of `or` are concatenated, and stay a bag unless opts.distinct.
    """
    select = select_list(q)
    contexts = contexts_of(graph, q.contexts) if q.contexts else None
    out = None
    for d in q.disjuncts:
        part = _branch(graph, d, select, q, contexts, opts)
        out = part if out is None else out.unionByName(part)
    if opts.distinct:
        out = out.distinct()
    limit = q.limit if opts.limit == "query" else opts.limit
    return out.limit(limit) if limit is not None else out


def truncated(graph: Graph, q: Query) -> tuple[DataFrame, bool]:
    """A limited result and whether there was more of it."""
    more = compile_query(graph, q, Options(limit=(q.limit or 0) + 1)).count()
    return compile_query(graph, q), q.limit is not None and more > q.limit
