"""Recursive-descent parser of the native pattern language."""

from __future__ import annotations

import math
import re

from graphloom.plans.ast import (
    Alt, AttrAtom, AttrsAtom, Const, EdgeAtom, FactAtom, HasAtom, Label, Lookup, Opt, Plus, Query, QueryError, Seq, ShapeAtom, Star, TextAtom, TypeAtom, Var, Wild,
)

_TOKEN = re.compile(
    r"""\s*(?:(?P<var>\?[A-Za-z_]\w*)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>\d+\.\d+|\d+(?![\w]))|(?P<id>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op>->|[-()\[\]{},:=|/*+?.]))"""
)
_TEXT = ("contains", "fts", "fts_any", "fuzzy")


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"cannot read the query at: {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.end()))
            at = m.end()
        self.i = 0

    # Tokens
    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + k][:2] if self.i + k < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def take(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] in ("op", "id"):
            self.i += 1
            return True
        return False

    def word(self, value: str) -> bool:
        if self.peek()[0] == "id" and self.peek()[1].lower() == value:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise QueryError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.next()
        if kind == "id":
            return value
        raise QueryError(f"expected a name, found {value!r}")

    def string(self) -> str:
        kind, value = self.next()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind in ("id", "num"):
            return value
        raise QueryError(f"expected a string, found {value!r}")

    # Grammar
    def query(self) -> Query:
        select: list[str] = []
        if self.word("select"):
            while True:
                kind, value = self.peek()
                if kind == "var":
                    select.append(value[1:])
                    self.i += 1
                elif value == "*" or value == ",":
                    self.i += 1
                else:
                    break
        if not self.word("where"):
            raise QueryError("expected 'where'")
        disjuncts = [self.conjunction()]
        while self.word("or"):
            disjuncts.append(self.conjunction())
        limit, hops, conf, contexts = 20, None, None, []
        while self.peek()[0] != "end":
            if self.word("limit"):
                limit = int(self.number())
            elif self.word("max_hops"):
                hops = int(self.number())
            elif self.word("min_conf") or self.word("min_confidence"):
                c = float(self.number())
                if not math.isfinite(c) or not 0 <= c <= 1:
                    raise QueryError("min_conf lies in [0, 1]")
                conf = c if conf is None else max(conf, c)
            elif self.word("in"):
                if self.take("{"):
                    while not self.take("}"):
                        contexts.append(self.context())
                        self.take(",")
                else:
                    contexts.append(self.context())
            else:
                raise QueryError(f"unexpected {self.peek()[1]!r}")
        return Query(tuple(dict.fromkeys(select)), tuple(disjuncts), limit, tuple(contexts), hops, conf)

    def number(self) -> str:
        kind, value = self.next()
        if kind != "num":
            raise QueryError(f"expected a number, found {value!r}")
        return value

    def context(self):
        return int(self.next()[1]) if self.peek()[0] == "num" else self.string()

    def conjunction(self) -> tuple:
        atoms = [self.atom()]
        while self.take(","):
            atoms.append(self.atom())
        return tuple(atoms)

    def atom(self):
        kind, value = self.peek()
        low = value.lower()
        if kind == "id" and self.peek(1)[1] == "(":
            if low in ("attr", "has", "attrs", *_TEXT):
                return self.call(low)
            if low not in ("name", "entity"):
                return self.fact(None)
        term = self.term()
        kind, value = self.peek()
        if value == "=":
            self.i += 1
            return self.fact(term)
        if value == ":":
            self.i += 1
            return TypeAtom(term, self.name())
        if value == "." :
            self.i += 1
            key = self.name()
            self.need("=")
            return AttrAtom(term, key, self.string())
        if kind == "id" and value.lower() == "is":
            self.i += 1
            return TypeAtom(term, self.name())
        if kind == "id" and value.lower() == "has":
            self.i += 1
            return HasAtom(term, (self.name(),))
        if value == "{":
            return self.shape(term)
        if value == "-":
            self.i += 1
            bracket = self.take("[")
            path = self.regex()
            if bracket:
                self.need("]")
            self.need("->")
            return EdgeAtom(term, path, self.term())
        raise QueryError(f"unexpected {value!r} after a term")

    def call(self, name: str):
        self.i += 1
        self.need("(")
        term = self.term()
        args: list[str] = []
        pairs: list[tuple[str, str]] = []
        while self.take(","):
            if name == "attrs":
                key = self.name()
                self.need("=")
                pairs.append((key, self.string()))
            else:
                args.append(self.string())
        self.need(")")
        if name == "attr" and len(args) == 2:
            return AttrAtom(term, *args)
        if name == "has" and args:
            return HasAtom(term, tuple(args))
        if name == "attrs" and pairs:
            return AttrsAtom(term, tuple(pairs))
        if name == "fuzzy" and len(args) == 3:
            return TextAtom(name, term, args[0], args[1], int(args[2]))
        if name in ("contains", "fts", "fts_any") and len(args) == 2:
            return TextAtom(name, term, *args)
        raise QueryError(f"{name}(...) has the wrong arguments")

    def fact(self, term):
        relation = self.name()
        self.need("(")
        fields = []
        while not self.take(")"):
            key = self.name()
            self.need("=")
            fields.append((key, self.term()))
            self.take(",")
        return FactAtom(term, relation, tuple(fields))

    def shape(self, term):
        self.need("{")
        types, rels, pairs = [], [], []
        while not self.take("}"):
            if self.word("is"):
                types.append(self.name())
            else:
                name = self.name()
                if self.take("="):
                    pairs.append((name, self.string()))
                else:
                    rels.append(name)
            self.take(",")
        return ShapeAtom(term, tuple(types), tuple(rels), tuple(pairs))

    def term(self):
        kind, value = self.next()
        if kind == "var":
            return Var(value[1:])
        if kind == "num":
            return Const(int(value))
        if kind == "str":
            return Lookup("name", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "id":
            if value == "_":
                return Wild()
            if value in ("name", "entity") and self.peek()[1] == "(":
                self.i += 1
                first = self.string()
                second = self.string() if self.take(",") else None
                self.need(")")
                return Lookup("name", first) if value == "name" else Lookup(first, second or "")
            return Lookup("name", value)
        raise QueryError(f"expected a term, found {value!r}")

    # Path expressions: alternation, then concatenation, then one repetition mark an atom.
    def regex(self):
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def sequence(self):
        parts = [self.repeat()]
        while self.take("/"):
            parts.append(self.repeat())
        return parts[0] if len(parts) == 1 else Seq(tuple(parts))

    def repeat(self):
        if self.take("("):
            inner = self.regex()
            self.need(")")
        else:
            inner = Label(self.name())
        for mark, kind in (("*", Star), ("+", Plus), ("?", Opt)):
            if self.take(mark):
                return kind(inner)
        return inner


def parse_query(text: str) -> Query:
    """A query of the native language."""
    p = Parser(text)
    q = p.query()
    return q


def parse_regex(text: str):
    """A path expression such as a/(b|c)*."""
    p = Parser(text)
    out = p.regex()
    if p.peek()[0] != "end":
        raise QueryError(f"unexpected {p.peek()[1]!r} in a path")
    return out
