"""The other query surfaces: SQL-like text, JSON, and question templates; and text and JSON out of a query."""

from __future__ import annotations

import hashlib
import json
import re

from graphloom.plans.ast import (
    AttrAtom, AttrsAtom, Const, EdgeAtom, FactAtom, HasAtom, Lookup, Query, QueryError, ShapeAtom, TextAtom, TypeAtom, Var, Wild, show_regex,
)
from graphloom.plans.parse_native import parse_regex

# SQL-like ------------------------------------------------------------------------
_SQL = re.compile(r"""\s*(?:(?P<str>'(?:''|[^'])*')|(?P<num>\d+)|(?P<id>[A-Za-z_][\w.]*)|(?P<op>[(),=*;]))""")
_IGNORED = ("group", "order", "having", "join", "distinct", "union", "offset", "inner", "left", "or")


def parse_sqlish(text: str) -> Query:
    """SELECT vars FROM Type AS x, ... WHERE FOLLOW / HAS / ATTR predicates joined by AND, LIMIT n."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _SQL.match(text, at)
        if not m:
            raise QueryError(f"cannot read SQL at: {text[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if tokens and tokens[-1][1] == ";":
        tokens.pop()
    for kind, value in tokens:
        if kind == "id" and value.lower() in _IGNORED:
            raise QueryError(f"{value.upper()} is not part of this SQL")
    i = 0

    def low(k: int = 0) -> str:
        return tokens[i + k][1].lower() if i + k < len(tokens) else ""

    def want(value: str) -> None:
        nonlocal i
        if low() != value:
            raise QueryError(f"expected {value.upper()}, found {low()!r}")
        i += 1

    def take() -> tuple[str, str]:
        nonlocal i
        if i >= len(tokens):
            raise QueryError("the SQL ends too soon")
        i += 1
        return tokens[i - 1]

    def text_of(t: tuple[str, str]) -> str:
        return t[1][1:-1].replace("''", "'") if t[0] == "str" else t[1]

    def term_of(t: tuple[str, str]):
        if t[0] == "num":
            return Const(int(t[1]))
        return Lookup("name", text_of(t)) if t[0] == "str" else Var(t[1])

    def args() -> list[tuple[str, str]]:
        want("(")
        out = []
        while low() != ")":
            out.append(take())
            if low() == ",":
                take()
        take()
        return out

    want("select")
    select: list[str] = []
    while low() != "from" and i < len(tokens):
        kind, value = take()
        if value == "*" or value == ",":
            continue
        if kind != "id":
            raise QueryError("only variables can be selected")
        if low() == "as":
            take()
            value = take()[1]  # the alias is the variable that is selected
        select.append(value)
    atoms: list = []
    want("from")
    while True:
        kind = take()[1]
        if low() == "as":
            take()
        if i >= len(tokens) or tokens[i][0] != "id" or low() in ("where", "limit"):
            raise QueryError(f"FROM {kind} needs an alias")
        atoms.append(TypeAtom(Var(take()[1]), kind))
        if low() != ",":
            break
        take()
    if low() == "where":
        while True:
            take()
            name = take()[1].lower()
            a = args()
            if name in ("follow", "edge", "path") and len(a) == 3:
                atoms.append(EdgeAtom(term_of(a[0]), parse_regex(text_of(a[1])), term_of(a[2])))
            elif name in ("has", "has_out") and len(a) >= 2:
                atoms.append(HasAtom(term_of(a[0]), tuple(map(text_of, a[1:]))))
            elif name == "attr" and len(a) == 2:
                want("=")
                atoms.append(AttrAtom(term_of(a[0]), text_of(a[1]), text_of(take())))
            else:
                raise QueryError(f"unknown predicate {name.upper()}")
            if low() != "and":
                break
    limit = 20
    if low() == "limit":
        take()
        limit = int(take()[1])
    if i < len(tokens):
        raise QueryError(f"unexpected {tokens[i][1]!r}")
    return Query(tuple(dict.fromkeys(select)), (tuple(atoms),), limit)


# Question templates -----------------------------------------------------------------
def parse_ask(text: str) -> Query:
    """'find Type [named n] [has r] [with k = v] [limit n]' or '[from x] follow path [max_hops n]'."""
    words = re.findall(r'"[^"]*"|\S+', text)
    words = words[1:] if words and words[0].lower() == "ask" else words
    low = [w.lower() for w in words]
    plain = lambda w: w.strip("\"'")
    if "follow" in low:
        start = low.index("follow")
        if low[:1] == ["from"] and start == 2:
            begin = words[1]
        elif low[1:2] == ["from"] and len(words) > 3:
            begin, words, low = words[2], [words[0], *words[3:]], [low[0], *low[3:]]
            start = 0
        else:
            raise QueryError("a follow question is 'from x follow path'")
        rest = low[start + 2 :]
        number = lambda k, d: int(rest[rest.index(k) + 1]) if k in rest else d
        left = Const(int(begin)) if begin.isdigit() else Lookup("name", plain(begin))
        conf = float(rest[rest.index("min_conf") + 1]) if "min_conf" in rest else None
        return Query(("y",), ((EdgeAtom(left, parse_regex(words[start + 1]), Var("y")),),), number("limit", 20), (), number("max_hops", None), conf)
    if low[:1] != ["find"] or len(words) < 2:
        raise QueryError("ask 'find ...' or 'from ... follow ...'")
    atoms: list = []
    kind = words[1]
    if low[1] not in ("things", "entities", "anything", "nodes", "all"):
        atoms.append(TypeAtom(Var("x"), kind))
    elif low[1] == "nodes":
        atoms.append(TypeAtom(Var("x"), "Node"))
    i, limit = 2, 20
    while i < len(words):
        if low[i] in ("named", "called") and i + 1 < len(words):
            atoms.append(AttrAtom(Var("x"), "name", plain(words[i + 1])))
            i += 2
        elif low[i] == "has" and i + 1 < len(words):
            atoms.append(HasAtom(Var("x"), (words[i + 1],)))
            i += 2
        elif low[i] in ("with", "where", "and") and i + 3 < len(words) and low[i + 2] in ("=", "is"):
            atoms.append(AttrAtom(Var("x"), words[i + 1], plain(words[i + 3])))
            i += 4
        elif low[i] == "limit" and i + 1 < len(words):
            limit = int(words[i + 1])
            i += 2
        else:
            raise QueryError(f"cannot read {words[i]!r} in a question")
    if not atoms:
        raise QueryError("the question asks for nothing")
    return Query(("x",), (tuple(atoms),), limit)


# JSON -------------------------------------------------------------------------------
_OPS = ("contains", "fts", "fts_any", "fuzzy")


def _term_in(x):
    if isinstance(x, bool) or x is None:
        raise QueryError("a term is a string, a number or an object")
    if isinstance(x, int):
        return Const(x)
    if isinstance(x, str):
        return Wild() if x == "_" else Var(x[1:]) if x.startswith("?") else Lookup("name", x)
    kind = x.get("kind")
    if kind == "var":
        return Var(x["name"].removeprefix("?"))
    if kind == "name":
        return Lookup("name", x["value"])
    if kind == "entity":
        return Lookup(x["key"], x["value"])
    if kind == "wildcard":
        return Wild()
    raise QueryError(f"unknown term {x!r}")


def _term_out(t):
    if isinstance(t, Var):
        return "?" + t.name
    if isinstance(t, Const):
        return t.id
    if isinstance(t, Wild):
        return "_"
    return t.value if t.key == "name" else {"kind": "entity", "key": t.key, "value": t.value}


def _atom_in(a: dict):
    kind = a.get("kind")
    t = lambda k="term": _term_in(a[k])
    if kind == "type":
        return TypeAtom(t(), a["type"])
    if kind in ("edge", "path"):
        return EdgeAtom(t("left"), parse_regex(a["path"]), t("right"))
    if kind == "attr_eq":
        return AttrAtom(t(), a["key"], a["value"])
    if kind in ("attr_contains", "attr_fts", "attr_fts_any"):
        return TextAtom(kind[5:], t(), a["key"], a.get("needle", a.get("query")))
    if kind == "attr_fuzzy":
        return TextAtom("fuzzy", t(), a["key"], a["needle"], int(a.get("max_dist", 1)))
    if kind in ("has", "has_out"):
        return HasAtom(t(), tuple(a["rels"]))
    if kind == "attrs":
        return AttrsAtom(t(), tuple(sorted(a["pairs"].items())))
    if kind == "shape":
        return ShapeAtom(t(), tuple(a.get("types", ())), tuple(a.get("rels", ())), tuple(sorted(a.get("attrs", {}).items())))
    if kind == "fact":
        return FactAtom(_term_in(a["fact"]) if a.get("fact") is not None else None, a["relation"], tuple((k, _term_in(v)) for k, v in a["fields"].items()))
    raise QueryError(f"unknown atom {kind!r}")


def _atom_out(a) -> dict:
    if isinstance(a, TypeAtom):
        return {"kind": "type", "term": _term_out(a.term), "type": a.type}
    if isinstance(a, EdgeAtom):
        return {"kind": "edge", "left": _term_out(a.left), "path": show_regex(a.path), "right": _term_out(a.right)}
    if isinstance(a, AttrAtom):
        return {"kind": "attr_eq", "term": _term_out(a.term), "key": a.key, "value": a.value}
    if isinstance(a, TextAtom):
        out = {"kind": f"attr_{a.op}", "term": _term_out(a.term), "key": a.key, "query" if a.op.startswith("fts") else "needle": a.text}
        return out | ({"max_dist": a.distance} if a.op == "fuzzy" else {})
    if isinstance(a, HasAtom):
        return {"kind": "has", "term": _term_out(a.term), "rels": list(a.rels)}
    if isinstance(a, AttrsAtom):
        return {"kind": "attrs", "term": _term_out(a.term), "pairs": dict(a.pairs)}
    if isinstance(a, ShapeAtom):
        return {"kind": "shape", "term": _term_out(a.term), "types": list(a.types), "rels": list(a.rels), "attrs": dict(a.pairs)}
    return {"kind": "fact", "fact": _term_out(a.fact) if a.fact is not None else None, "relation": a.relation, "fields": {k: _term_out(v) for k, v in a.fields}}


def from_json(data: str | dict) -> Query:
    """A query from its JSON form, version 1."""
    d = json.loads(data) if isinstance(data, str) else data
    if d.get("version", 1) != 1:
        raise QueryError("version 1 of the JSON form is known")
    where = d.get("where", d.get("where_atoms"))
    disjuncts = d.get("disjuncts") or ([where] if where is not None else None)
    if not disjuncts:
        raise QueryError("a query needs 'where' or 'disjuncts'")
    contexts = tuple(c if isinstance(c, (int, str)) else c["id"] if c["kind"] == "entity_id" else c["name"] for c in d.get("contexts", ()))
    select = tuple(s.removeprefix("?") for s in d.get("select", d.get("select_vars", ())))
    return Query(select, tuple(tuple(map(_atom_in, x)) for x in disjuncts), d.get("limit") or 20, contexts, d.get("max_hops"), d.get("min_confidence"))


def to_json(q: Query) -> dict:
    return {
        "version": 1, "select": ["?" + s for s in q.select], "disjuncts": [[_atom_out(a) for a in x] for x in q.disjuncts],
        "limit": q.limit, "max_hops": q.max_hops, "min_confidence": q.min_conf, "contexts": list(q.contexts),
    }


def json_schema() -> dict:
    """A JSON schema of the query form."""
    term = {"oneOf": [{"type": "string"}, {"type": "integer"}, {"type": "object", "required": ["kind"]}]}
    kinds = ["type", "edge", "attr_eq", "attr_contains", "attr_fts", "attr_fts_any", "attr_fuzzy", "has", "attrs", "shape", "fact"]
    atom = {"type": "object", "required": ["kind"], "properties": {"kind": {"enum": kinds}, "term": term, "left": term, "right": term}}
    return {"type": "object", "required": ["version"], "properties": {"version": {"const": 1}, "where": {"type": "array", "items": atom}, "disjuncts": {"type": "array", "items": {"type": "array", "items": atom}}, "limit": {"type": "integer"}, "min_confidence": {"type": "number"}}}


# Text -----------------------------------------------------------------------------------
def _term_text(t) -> str:
    if isinstance(t, Var):
        return "?" + t.name
    if isinstance(t, Const):
        return str(t.id)
    if isinstance(t, Wild):
        return "_"
    return f"name({json.dumps(t.value)})" if t.key == "name" else f"entity({json.dumps(t.key)}, {json.dumps(t.value)})"


def _atom_text(a) -> str:
    q = json.dumps
    if isinstance(a, TypeAtom):
        return f"{_term_text(a.term)} : {a.type}"
    if isinstance(a, EdgeAtom):
        return f"{_term_text(a.left)} -[{show_regex(a.path)}]-> {_term_text(a.right)}"
    if isinstance(a, AttrAtom):
        return f"attr({_term_text(a.term)}, {q(a.key)}, {q(a.value)})"
    if isinstance(a, TextAtom):
        return f"{a.op}({_term_text(a.term)}, {q(a.key)}, {q(a.text)}" + (f", {a.distance})" if a.op == "fuzzy" else ")")
    if isinstance(a, HasAtom):
        return f"has({_term_text(a.term)}, {', '.join(a.rels)})"
    if isinstance(a, AttrsAtom):
        return f"attrs({_term_text(a.term)}, {', '.join(f'{k}={q(v)}' for k, v in a.pairs)})"
    if isinstance(a, ShapeAtom):
        return f"{_term_text(a.term)} {{ {', '.join([*(f'is {t}' for t in a.types), *a.rels, *(f'{k}={q(v)}' for k, v in a.pairs)])} }}"
    head = f"{_term_text(a.fact)} = " if a.fact is not None else ""
    return f"{head}{a.relation}({', '.join(f'{k}={_term_text(v)}' for k, v in a.fields)})"


def to_text(q: Query) -> str:
    """The query in the native language; parsing it gives the query back."""
    out = f"select {' '.join('?' + s for s in q.select) or '*'} where " + " or ".join(", ".join(map(_atom_text, d)) for d in q.disjuncts)
    if q.contexts:
        out += " in " + (str(q.contexts[0]) if len(q.contexts) == 1 else "{" + ", ".join(map(str, q.contexts)) + "}")
    out += f" max_hops {q.max_hops}" if q.max_hops is not None else ""
    out += f" min_conf {q.min_conf}" if q.min_conf is not None else ""
    return out + (f" limit {q.limit}" if q.limit is not None else "")


def digest(q: Query) -> str:
    """A key for caches of prepared queries."""
    return hashlib.sha256(json.dumps(to_json(q), sort_keys=True).encode()).hexdigest()
