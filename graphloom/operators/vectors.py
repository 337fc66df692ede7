"""Approximate nearest vectors: cells around centres, of which a query looks into the nearest few.

The centres are fitted on a bounded sample; every row is indexed. A cell of many rows is
dealt over several parts, so no task holds an unbounded one. Scores of what is looked at
are exact, so only a neighbour in a cell that was not probed can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut

#: Vectors that the centres are fitted on, about and at most; rows of a part of a cell, about.
SAMPLE, PART = 20_000, 20_000


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _sample(vectors: DataFrame, n: int, sample: int, seed: int) -> np.ndarray:
    """About `sample` vectors, and at most so many, of the least hashes of their ids."""
    low = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(min(1 << 30, (sample << 30) // max(n, 1)))
    v = vectors.where(low).select("vector").limit(sample).toArrow()["vector"].combine_chunks()
    return _unit(_matrix(v, len(v))) if len(v) else np.zeros((0, 1))


def probes_for(vectors: DataFrame, centres: np.ndarray, k: int, share: float = 0.95, sample: int = SAMPLE, queries: int = 500, seed: int = 2) -> int:
    """How many cells a query is to look into, so that of the k nearest of sampled vectors `share` are found."""
    x = _sample(vectors, vectors.count(), sample, seed)
    q = x[:queries]
    if len(x) < 2:
        return 1
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2  # its own
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    own = (x @ centres.T).argmax(axis=1)
    needed = np.take_along_axis(place, own[near], axis=1) + 1
    return int(np.quantile(needed, share, method="higher"))


def fit_centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Unit centres by spherical k-means on about `sample` vectors of the least hashes; cells: the root of their number if not said."""
    n = vectors.count()
    x = _sample(vectors, n, sample, seed)
    k = min(len(x), cells or max(1, round(n**0.5)))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds if k else 0):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.bincount(own, minlength=k)[:, None] > 0, _unit(sums), centres)
    return centres


def cell_index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """cell, part, id, vector (unit length) of every row of vectors (id, vector)."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # cells times dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("vector"), batch.num_rows))
                cell = (x @ sent.value.T).argmax(axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), flat], ["cell", "id", "vector"])

    placed = cut(vectors.select("id", "vector").mapInArrow(run, f"cell int, id {dict(vectors.dtypes)['id']}, vector array<double>"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row for each cell
    return placed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts", "id", "vector")


def search_cells(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """query_id, id, score (cosine, nine digits), rank: the k nearest in the `probes` cells nearest to each of queries (query_id, query); a query's own id does not count."""
    sent = queries.sparkSession.sparkContext.broadcast(centres)
    kind, own_kind = dict(queries.dtypes)["query_id"], dict(index.dtypes)["id"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _unit(_matrix(batch.column("query"), batch.num_rows))
                many = min(probes, len(sent.value))
                cells = np.argpartition(-(q @ sent.value.T), many - 1, axis=1)[:, :many]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, q.shape[1]), pa.int32()), pa.array(q.ravel()))
                at = pa.array(np.repeat(np.arange(len(q)), many))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), batch.column("query_id").take(at), flat.take(at)], ["cell", "query_id", "query"])

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not own.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (asked.schema.field("query_id").type, own.schema.field("id").type, pa.float64()))})
        v, ids = _matrix(own["vector"].combine_chunks(), own.num_rows), own["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        out: list[list[np.ndarray]] = [[], [], []]
        who, q = asked["query_id"].to_numpy(), _matrix(asked["query"].combine_chunks(), asked.num_rows)
        for at in range(0, len(q), 512):
            s = np.round(q[at : at + 512] @ v.T, 9)
            best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            rows = np.repeat(np.arange(len(best)), best.shape[1])
            a, b, c = who[at : at + 512][rows], ids[best.ravel()], s[rows, best.ravel()]
            for o, x in zip(out, (a, b, c)):
                o.append(x[a != b])
        return pa.table({n: pa.array(np.concatenate(o)) for n, o in zip(names, out)})

    parts = cut(index.select("cell", "part").distinct())
    asked = queries.select("query_id", "query").mapInArrow(near, f"cell int, query_id {kind}, query array<double>").join(parts, "cell")
    found = index.select("cell", "part", "id", "vector").groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(meet, f"query_id {kind}, id {own_kind}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, id) that were found."""
    hits = exact.select("query_id", "id").intersect(found.select("query_id", "id")).count()
    return hits / max(1, exact.count())
