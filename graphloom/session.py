"""One object over a graph: every query surface, and the analytics by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.plans import surfaces
from graphloom.plans.ast import Query
from graphloom.plans.compile import Options, compile_query, truncated
from graphloom.plans.elaborate import elaborate
from graphloom.plans.parse_native import parse_query
from graphloom.snapshot import Graph

_READERS = {"native": parse_query, "sqlish": surfaces.parse_sqlish, "json": surfaces.from_json, "ask": surfaces.parse_ask}


class GraphSession:
    """Queries over a snapshot. Prepared queries are kept by their digest; a session serves one snapshot."""

    def __init__(self, graph: Graph, contexts: tuple = (), keep: int = 32):
        self.graph, self.contexts, self.keep = graph, tuple(contexts), keep
        self._prepared: dict[tuple, DataFrame] = {}

    def parse(self, text, lang: str = "native") -> Query:
        if isinstance(text, Query):
            return text
        if lang not in _READERS:
            raise ValueError(f"unknown language {lang}")
        return _READERS[lang](text)

    def query(self, text, lang: str = "native", contexts: tuple = (), limit: int | None | str = "query", distinct: bool = False, rewrite: bool = False, strict_max_hops: bool = False) -> DataFrame:
        q = self.parse(text, lang)
        if not q.contexts and (contexts or self.contexts):
            q = q.with_(contexts=tuple(contexts or self.contexts))
        opts = Options(limit, distinct, rewrite, strict_max_hops)
        key = (surfaces.digest(q), opts, self.graph.snapshot_id)
        if key not in self._prepared:
            if len(self._prepared) >= self.keep:
                self._prepared.pop(next(iter(self._prepared)))
            self._prepared[key] = compile_query(self.graph, q, opts)
        return self._prepared[key]

    def rows(self, text, lang: str = "native") -> tuple[list, bool]:
        """Limited rows, and whether the limit cut some off."""
        df, more = truncated(self.graph, self.parse(text, lang))
        return df.collect(), more

    def elaborate(self, text, lang: str = "native", rewrite: bool = False) -> tuple[str, list[str]]:
        q, notes = elaborate(self.parse(text, lang), self.graph, rewrite)
        return surfaces.to_text(q), notes

    def explain(self, text, lang: str = "native") -> str:
        df = self.query(text, lang)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def describe(self, ident: int) -> DataFrame:
        return self.graph.entity(ident)
