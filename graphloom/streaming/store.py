"""A store of snapshots: reviewed modules, an append-only log of overlays, time travel, and versioned rows."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.constraints import check_constraints, quality_report
from graphloom.snapshot import Graph
from graphloom.sources import modules

LOG = "seq bigint, snapshot_id string, parent string, kind string, digest string, path string, at timestamp"


class Store:
    """Snapshots under a path that all executors reach. The log is appended to, never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except Exception as e:  # the folder comes with the first entry
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def _append(self, snapshot: str, parent: str | None, kind: str, digest: str, path: str) -> str:
        n = self.log().agg(F.max("seq")).first()[0]
        row = self.spark.createDataFrame([((n or 0) + 1, snapshot, parent, kind, digest, path, None)], LOG).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return snapshot

    def head(self) -> str | None:
        return self.log().agg(F.max_by("snapshot_id", "seq")).first()[0]

    def snapshots(self) -> DataFrame:
        return self.log().orderBy("seq")

    def resolve(self, name: str) -> str:
        """A snapshot by its id, a prefix that only it has, or 'head' or 'latest'."""
        if name in ("head", "latest"):
            found = self.head()
            if found is None:
                raise KeyError("the store is empty")
            return found
        hits = [r[0] for r in self.log().where(F.col("snapshot_id").startswith(name)).select("snapshot_id").distinct().limit(2).collect()]
        if len(hits) != 1:
            raise KeyError(f"{name} is {'no snapshot' if not hits else 'ambiguous'}")
        return hits[0]

    def promote(self, text: str, profile: str = "fast") -> str:
        """A reviewed module becomes the head, if it is well typed, keeps its constraints and shows no error."""
        m = modules.parse_module(text)
        g = modules.import_module(self.spark, m)
        named = {r: modules.names_of(g, r) for r in g.wide}
        if named and not (bad := check_constraints(named, g.meta.constraints)).isEmpty():
            raise ValueError(f"constraints are broken: {[r.constraint for r in bad.limit(5).collect()]}")
        errors = quality_report(g, profile).where("level = 'error'")
        if not errors.isEmpty():
            raise ValueError(f"the quality check found {[r.code for r in errors.limit(5).collect()]}")
        return self.commit_graph(g, "module", hashlib.sha256(text.encode()).hexdigest())

    def commit_graph(self, graph: Graph, kind: str = "graph", digest: str = "") -> str:
        ident = uuid.uuid4().hex
        graph.write(f"{self.path}/snapshots/{ident}")
        return self._append(ident, self.head(), kind, digest, f"{self.path}/snapshots/{ident}")

    def commit_overlay(self, table: str, rows: DataFrame) -> str:
        """Rows added to one table of the head; only they are written."""
        ident = uuid.uuid4().hex
        path = f"{self.path}/overlays/{ident}"
        rows.write.parquet(path)
        return self._append(ident, self.head(), f"overlay:{table}", digest_of(rows), path)

    def read(self, name: str = "head") -> Graph:
        """A snapshot: the last whole graph before it and the overlays since then, in order, their digests checked."""
        ident = self.resolve(name)
        by_id = {r.snapshot_id: r for r in self.log().collect()}  # a row for each commit
        chain = []
        while ident and by_id[ident].kind.startswith("overlay:"):
            chain.append(by_id[ident])
            ident = by_id[ident].parent
        if ident is None:
            raise KeyError("an overlay without a graph under it")
        g = Graph.read(self.spark, by_id[ident].path)
        for r in reversed(chain):
            rows = self.spark.read.parquet(r.path)
            if digest_of(rows) != r.digest:
                raise ValueError(f"overlay {r.snapshot_id} is not what was committed")
            g = g.add(**{r.kind.split(":", 1)[1]: rows})
        return g

    def checkpoint(self) -> str:
        """The head as one whole graph, so that reading it needs no overlays."""
        return self.commit_graph(self.read("head"), "checkpoint")

    def rollback(self, name: str) -> str:
        """An earlier snapshot becomes the head again, by a new entry."""
        r = self.log().where(F.col("snapshot_id") == self.resolve(name)).first()
        if r.kind.startswith("overlay:"):
            return self.commit_graph(self.read(name), "rollback")
        return self._append(uuid.uuid4().hex, self.head(), "rollback", r.digest, r.path)


def digest_of(rows: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows."""
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("*").cast("decimal(20,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([r.n, str(r.s), sorted(rows.columns)]).encode()).hexdigest()


def versioned_read(rows: DataFrame, version: int) -> DataFrame:
    """key, value as of a version of (key, version, deleted, value); a deletion hides its key."""
    now = rows.where(F.col("version") <= version).groupBy("key").agg(F.max_by(F.struct("deleted", "value"), "version").alias("x"))
    return now.where(~F.col("x.deleted")).select("key", "x.value")


def collect_garbage(rows: DataFrame, oldest: int) -> DataFrame:
    """Versions that a read at `oldest` or later can still see."""
    keep = rows.where(F.col("version") <= oldest).groupBy("key").agg(F.max("version").alias("last"))
    return rows.join(keep, "key", "left").where(F.col("last").isNull() | (F.col("version") >= F.col("last"))).drop("last")


def wait_for_head(store: Store, known: str | None, seconds: float = 10.0, every: float = 0.5) -> str | None:
    """The head once it is another than the one known, or after some seconds the same."""
    end = time.time() + seconds
    while (now := store.head()) == known and time.time() < end:
        time.sleep(every)
    return now
