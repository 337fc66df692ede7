"""Checks and rewrites on the syntax tree, before any table is touched."""

from __future__ import annotations

from graphloom.plans.ast import (
    Alt, AttrAtom, AttrsAtom, Const, EdgeAtom, FactAtom, HasAtom, InIds, Label, Lookup, Query, QueryError, Seq, ShapeAtom, TypeAtom, Var, Wild, chain_of, labels_of, map_labels, terms_of, vars_of,
)
from graphloom.snapshot import Graph, Meta


def expand(atoms) -> tuple:
    """Macros into plain atoms; wildcards and lookups into variables of their own.

    Each wildcard is a variable for itself; lookups of one key and value share one.
    """
    out: list = []
    lookups: dict[Lookup, Var] = {}
    n = 0

    def fresh(kind: str) -> Var:
        nonlocal n
        n += 1
        return Var(f"_{kind}{n}")

    def term(t):
        if isinstance(t, Wild):
            return fresh("anon")
        if isinstance(t, Lookup):
            if t not in lookups:
                lookups[t] = fresh("lookup")
                out.append(AttrAtom(lookups[t], t.key, t.value))
            return lookups[t]
        return t

    for a in atoms:
        if isinstance(a, (HasAtom, AttrsAtom, ShapeAtom)):
            t = term(a.term)
            out += [TypeAtom(t, x) for x in getattr(a, "types", ())]
            out += [EdgeAtom(t, Label(r), fresh("anon")) for r in getattr(a, "rels", ())]
            out += [AttrAtom(t, k, v) for k, v in getattr(a, "pairs", ())]
        elif isinstance(a, EdgeAtom):
            out.append(EdgeAtom(term(a.left), a.path, term(a.right)))
        elif isinstance(a, FactAtom):
            out.append(FactAtom(term(a.fact) if a.fact is not None else fresh("fact"), a.relation, tuple((k, term(v)) for k, v in a.fields)))
        else:
            out.append(type(a)(*(term(v) if k == "term" else v for k, v in a.__dict__.items())))
    # A schema before a type's name is an attribute of the entity.
    final: list = []
    for a in out:
        if isinstance(a, TypeAtom) and "." in a.type:
            schema, name = a.type.rsplit(".", 1)
            final += [TypeAtom(a.term, name), AttrAtom(a.term, "in_schema", schema)]
        else:
            final.append(a)
    return tuple(final)


def typecheck(atoms, meta: Meta) -> None:
    """Unknown types and fields are errors where there are declarations to know them by."""
    if not meta:
        return
    for a in atoms:
        if isinstance(a, TypeAtom) and meta.types and a.type not in meta.types and not any(a.type in x for x in meta.subtypes) and not any(a.type in (r, f"{r}Fact") for _, r in meta.relations) and a.type not in ("Morphism", "Homotopy"):
            raise QueryError(f"unknown type {a.type}")
        if isinstance(a, FactAtom):
            own = declared(meta, a.relation)
            if own is not None:
                for f, _ in a.fields:
                    if f not in [x for x, _ in own]:
                        raise QueryError(f"{a.relation} has no field {f}")


def declared(meta: Meta, relation: str):
    """Fields of a relation, named with or without its schema; None if nothing declares it."""
    schema, _, name = relation.rpartition(".")
    for (s, r), fields in meta.relations.items():
        if r == name and (not schema or s == schema):
            return fields
    return None


def implied_types(atoms, meta: Meta) -> tuple[tuple, list[str]]:
    """Type atoms that the fields of facts imply, for those who want them spelled out."""
    known = {(a.term, a.type) for a in atoms if isinstance(a, TypeAtom)}
    extra, notes = [], []
    for a in atoms:
        if isinstance(a, FactAtom):
            fields = dict(declared(meta, a.relation) or ())
            for f, t in a.fields:
                if isinstance(t, Var) and f in fields and (t, fields[f]) not in known:
                    known.add((t, fields[f]))
                    extra.append(TypeAtom(t, fields[f]))
                    notes.append(f"?{t.name} : {fields[f]} follows from {a.relation}.{f}")
    return tuple([*atoms, *extra]), notes


def endpoint_types(meta: Meta, label: str) -> tuple[str | None, str | None]:
    fields = declared(meta, label)
    if not fields:
        return None, None
    plain = [t for f, t in fields if f not in ("ctx", "time")]
    return (plain[0], plain[1]) if len(plain) == 2 else (None, None)


def check_chains(atoms, meta: Meta) -> None:
    """A chain whose steps cannot meet, by their declared ends, is an error."""
    if not meta:
        return
    for a in atoms:
        labels = chain_of(a.path) if isinstance(a, EdgeAtom) else None
        for x, y in zip(labels or (), (labels or ())[1:]):
            end, begin = endpoint_types(meta, x)[1], endpoint_types(meta, y)[0]
            if end and begin and not meta.is_subtype(end, begin) and not meta.is_subtype(begin, end):
                raise QueryError(f"{x} ends in {end} but {y} begins in {begin}")


def qualify(atoms, meta: Meta, present: set[str]) -> tuple[tuple, list[str]]:
    """A label that several schemas declare, and that stands only qualified, becomes a choice among them."""
    notes: list[str] = []

    def one(label: Label):
        if label.name in present or "." in label.name:
            return label
        own = [f"{s}.{label.name}" for s in meta.schemas_of(label.name)]
        own = [x for x in own if x in present] or own
        if len(own) > 1:
            notes.append(f"{label.name} is declared by several schemas: {', '.join(own)}")
            return Alt(tuple(Label(x) for x in own))
        return Label(own[0]) if own and own[0] in present else label

    return tuple(EdgeAtom(a.left, map_labels(a.path, one), a.right) if isinstance(a, EdgeAtom) else a for a in atoms), notes


def canonical_paths(atoms, meta: Meta, rounds: int = 4) -> tuple:
    """Chains that a rule reads both ways, replaced by the smaller side (shorter, then by text). Opt-in."""
    key = lambda c: (len(c), c)
    rules = [(max(r.left, r.right, key=key), min(r.left, r.right, key=key), r.ends) for r in meta.rules if r.bidirectional and r.left != r.right]
    out = list(atoms)
    for _ in range(rounds):
        changed = False
        for i, a in enumerate(out):
            labels = chain_of(a.path) if isinstance(a, EdgeAtom) else None
            for big, small, ends in rules:
                if labels is not None and tuple(labels) == big and _ends_hold(out, a, ends, meta):
                    out[i] = EdgeAtom(a.left, Label(small[0]) if len(small) == 1 else Seq(tuple(Label(x) for x in small)), a.right)
                    changed = True
                    break
        if not changed:
            break
    return tuple(out)


def _ends_hold(atoms, edge: EdgeAtom, ends, meta: Meta) -> bool:
    for term, want in zip((edge.left, edge.right), ends):
        if want and not any(isinstance(a, TypeAtom) and a.term == term and meta.is_subtype(a.type, want) for a in atoms):
            return False
    return True


def select_list(q: Query) -> tuple[str, ...]:
    """What is selected: as written, or all visible variables that every branch has."""
    from graphloom.plans.ast import is_internal

    each = [[v for v in vars_of(d) if not is_internal(v)] for d in q.disjuncts]
    if not q.select:
        return tuple(v for v in each[0] if all(v in e for e in each))
    for v in q.select:
        if any(v not in vars_of(d) for d in q.disjuncts):
            raise QueryError(f"?{v} is selected but does not stand in every branch")
    return q.select


def elaborate(q: Query, graph: Graph, rewrite: bool = False) -> tuple[Query, list[str]]:
    """The query with implied types, for showing, and notes on what was inferred."""
    notes: list[str] = []
    branches = []
    for d in q.disjuncts:
        atoms = expand(d)
        typecheck(atoms, graph.meta)
        check_chains(atoms, graph.meta)
        if rewrite:
            atoms = canonical_paths(atoms, graph.meta)
        atoms, more = implied_types(atoms, graph.meta)
        notes += more
        branches.append(atoms)
    return q.with_(disjuncts=tuple(branches), select=select_list(q)), notes
