"""The one syntax tree that every query surface is parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class QueryError(ValueError):
    """A query that cannot be parsed, typed or resolved."""


# Terms -----------------------------------------------------------------------
@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    id: int


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Lookup:
    key: str
    value: str


Term = Var | Const | Wild | Lookup


# Path expressions --------------------------------------------------------------
@dataclass(frozen=True)
class Label:
    name: str


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Star:
    inner: object


@dataclass(frozen=True)
class Plus:
    inner: object


@dataclass(frozen=True)
class Opt:
    inner: object


def chain_of(regex) -> list[str] | None:
    """The labels of a plain chain a/b/c; None for anything richer."""
    if isinstance(regex, Label):
        return [regex.name]
    if isinstance(regex, Seq):
        parts = [chain_of(p) for p in regex.parts]
        return None if any(p is None for p in parts) else [x for p in parts for x in p]
    return None


def reverse(regex):
    """The expression that reads every path backwards."""
    if isinstance(regex, Seq):
        return Seq(tuple(reverse(p) for p in reversed(regex.parts)))
    if isinstance(regex, Alt):
        return Alt(tuple(reverse(p) for p in regex.parts))
    if isinstance(regex, (Star, Plus, Opt)):
        return type(regex)(reverse(regex.inner))
    return regex


def map_labels(regex, fn):
    if isinstance(regex, Label):
        return fn(regex)
    if isinstance(regex, (Seq, Alt)):
        return type(regex)(tuple(map_labels(p, fn) for p in regex.parts))
    return type(regex)(map_labels(regex.inner, fn))


def labels_of(regex) -> set[str]:
    out: set[str] = set()
    map_labels(regex, lambda l: out.add(l.name) or l)
    return out


def show_regex(regex, level: int = 0) -> str:
    if isinstance(regex, Label):
        return regex.name
    if isinstance(regex, Alt):
        text = "|".join(show_regex(p, 1) for p in regex.parts)
        return f"({text})"
    if isinstance(regex, Seq):
        text = "/".join(show_regex(p, 2) for p in regex.parts)
        return f"({text})" if level >= 2 else text
    mark = {Star: "*", Plus: "+", Opt: "?"}[type(regex)]
    inner = show_regex(regex.inner, 3)
    return (inner if isinstance(regex.inner, (Label, Alt)) else f"({inner})") + mark


# Atoms ---------------------------------------------------------------------------
@dataclass(frozen=True)
class TypeAtom:
    term: Term
    type: str


@dataclass(frozen=True)
class EdgeAtom:
    left: Term
    path: object
    right: Term


@dataclass(frozen=True)
class AttrAtom:
    term: Term
    key: str
    value: str


@dataclass(frozen=True)
class TextAtom:
    """op: contains, fts, fts_any or fuzzy."""

    op: str
    term: Term
    key: str
    text: str
    distance: int = 0


@dataclass(frozen=True)
class HasAtom:
    term: Term
    rels: tuple[str, ...]


@dataclass(frozen=True)
class AttrsAtom:
    term: Term
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class ShapeAtom:
    term: Term
    types: tuple[str, ...]
    rels: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class FactAtom:
    fact: Term | None
    relation: str
    fields: tuple[tuple[str, Term], ...]


@dataclass(frozen=True)
class InIds:
    """Internal: a term is one of these entities."""

    term: Term
    ids: tuple[int, ...]


@dataclass(frozen=True)
class Query:
    select: tuple[str, ...]
    disjuncts: tuple[tuple, ...]
    limit: int | None = 20
    contexts: tuple = ()
    max_hops: int | None = None
    min_conf: float | None = None
    notes: tuple[str, ...] = field(default=(), compare=False)

    def with_(self, **changes) -> Query:
        return replace(self, **changes)


def terms_of(atom) -> list[Term]:
    if isinstance(atom, EdgeAtom):
        return [atom.left, atom.right]
    if isinstance(atom, FactAtom):
        return [*([atom.fact] if atom.fact is not None else []), *(t for _, t in atom.fields)]
    return [atom.term]


def is_internal(name: str) -> bool:
    return name.startswith(("_anon", "_lookup", "_fact"))


def vars_of(atoms) -> list[str]:
    out: dict[str, None] = {}
    for a in atoms:
        for t in terms_of(a):
            if isinstance(t, Var):
                out.setdefault(t.name)
    return list(out)
