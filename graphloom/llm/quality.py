"""Quality classification from positive and unlabelled documents.

Features are counts of a text's characters, words and lines. The classifier minimises the
non-negative unbiased risk of positive-unlabelled learning: with class prior p, positives P
and unlabelled documents U, p * R+(P) + max(0, R-(U) - p * R-(P)), by sigmoid loss. Known
negatives never enter the risk; labels other than 1 only help to estimate the prior. The
model is fitted on a bounded sample; the threshold then comes from a histogram of the
scores of all documents that may be learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, materialize, text_slices

#: Rows of each kind (positive, unlabelled) that the classifier is fitted on at most.
FIT_ROWS = 20_000
THRESHOLD = 0.7
#: Cells of the histogram of raw scores: of this width, up to this size either way.
CELL, REACH = 1 / 256, 40

_CLASS = np.full(256, 7, np.int64)  # other bytes of ASCII
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:'\"?-()", b"!#$%&*|<>=~^_\\/{}[]@+")):
    _CLASS[list(_chars)] = _k
_CLASS[128:192], _CLASS[192:] = 8, 9  # the rest of a UTF-8 character, and its first byte
FEATURES = 24


def features_of(text: str | None) -> list[float]:
    """Numbers that describe a text; all of them from the whole of it."""
    if not text:
        return [0.0] * FEATURES
    data = text.encode()
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=byte, minlength=10)
    n = float(len(text))
    words = text.split()
    m = float(len(words)) or 1.0
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    q = float(len(lines)) or 1.0
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    low = text.lower().split()
    p = byte / max(1, byte.sum())
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    packed = len(zlib.compress(data[: 1 << 16], 1)) / min(len(data), 1 << 16) if len(data) <= 1 << 16 else float(np.mean([len(zlib.compress(data[i : i + (1 << 16)], 1)) / len(data[i : i + (1 << 16)]) for i in range(0, len(data), 1 << 16)]))
    return [
        np.log1p(n), np.log1p(m), n / m, *(kind[[0, 1, 2, 3, 4, 5, 6, 7, 9]] / n).tolist(),
        distinct / m, np.log1p(distinct), same / m, (len(set(low)) / m), len(set(lines)) / q, np.log1p(q), m / q, entropy, packed,
        byte[33] / n, (byte[124] + byte[9]) / n, max(byte[35], byte[36], byte[37], byte[38], byte[42]) / n,
    ]


def _features(text: pa.Array) -> np.ndarray:
    return np.array([features_of(t.as_py()) for t in text], np.float32).reshape(-1, FEATURES)


def feature_rows(docs: DataFrame) -> DataFrame:
    """features of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                x = _features(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))], ["features"])

    return docs.select("text").mapInArrow(run, "features array<float>")


class PositiveUnlabelled:
    """Logistic units over scaled features and one hidden layer, fitted by the non-negative risk."""

    def __init__(self, prior: float, hidden: int = 16, seed: int = 7):
        self.prior, self.hidden, self.seed = prior, hidden, seed
        self.shift = 0.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w1 + self.b1)
        return h, h @ self.w2 + x @ self.w3 + self.b2

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 60, batch: int = 512, rate: float = 0.01) -> PositiveUnlabelled:
        rng = np.random.default_rng(self.seed)
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self._scaled(positive), self._scaled(unlabelled)
        d = p.shape[1]
        self.w1, self.b1 = rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden)
        self.w2, self.w3, self.b2 = rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(d), 0.0
        names = ("w1", "b1", "w2", "w3", "b2")
        first = {k: np.zeros_like(np.asarray(getattr(self, k), float)) for k in names}
        second = {k: v.copy() for k, v in first.items()}
        step, share = 0, max(1, len(u) // batch)
        for _ in range(epochs):
            for up, uu in zip(np.array_split(rng.permutation(len(p)), share), np.array_split(rng.permutation(len(u)), share)):
                if not len(up) or not len(uu):
                    continue
                step += 1
                grad = self.gradient(p[up], u[uu])
                for name in ("w1", "w2"):
                    grad[name] = grad[name] + 1e-4 * getattr(self, name)
                for name in names:
                    first[name] = 0.9 * first[name] + 0.1 * grad[name]
                    second[name] = 0.999 * second[name] + 0.001 * grad[name] ** 2
                    move = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, getattr(self, name) - move)
        return self

    def risk(self, p: np.ndarray, u: np.ndarray) -> tuple[float, float]:
        """The risk of positives, times the prior, and that of negatives as positives and unlabelled ones show it."""
        zp, zu = (np.clip(self._forward(x)[1], -30, 30) for x in (p, u))
        loss = lambda z, sign: 1 / (1 + np.exp(sign * z))  # noqa: E731  of label sign
        return float(self.prior * loss(zp, 1).mean()), float(loss(zu, -1).mean() - self.prior * loss(zp, -1).mean())

    def gradient(self, p: np.ndarray, u: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of both risks; where that of negatives is below zero, of its opposite alone: a step back."""
        x, k = np.concatenate([p, u]), len(p)
        h, z = self._forward(x)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # loss of a negative; 1 - s is a positive's
        slope = s * (1 - s)
        g = np.zeros(len(x))
        if s[k:].mean() - self.prior * s[:k].mean() >= 0:
            g[:k] = -2 * self.prior * slope[:k] / k
            g[k:] = slope[k:] / len(u)
        else:
            g[:k] = self.prior * slope[:k] / k
            g[k:] = -slope[k:] / len(u)
        back = np.outer(g, self.w2) * (1 - h * h)
        return {"w1": x.T @ back, "b1": back.sum(axis=0), "w2": h.T @ g, "w3": x.T @ g, "b2": g.sum()}

    def calibrate(self, histogram: dict[int, int]) -> PositiveUnlabelled:
        """Put the threshold near the prior's quantile of all raw scores, counted by cells: where fewest are.

        Of the cells between the quantiles 0.02 above and below, the one with fewest scores
        within a quarter around it; of several in a row the middle one.
        """
        n = np.zeros(2 * int(REACH / CELL) + 1, np.int64)
        for cell, count in histogram.items():
            n[cell + int(REACH / CELL)] += count
        if n.sum():
            upto = np.cumsum(n)
            low, high = (int(np.searchsorted(upto, np.clip(1 - self.prior + d, 0, 1) * upto[-1])) for d in (-0.02, 0.02))
            high = min(max(low, high), len(n) - 1)
            half = int(0.25 / CELL)
            ends = np.r_[0, upto]
            near = ends[np.minimum(np.arange(low, high + 1) + half + 1, len(n))] - ends[np.maximum(np.arange(low, high + 1) - half, 0)]
            least = np.flatnonzero(near == near.min())
            first = least[0]
            last = first + int(np.argmax(np.r_[np.diff(least) != 1, True]))
            self.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - ((low + (first + last) / 2) * CELL - REACH))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Between -REACH and REACH, before the threshold has its place."""
        return np.clip(self._forward(self._scaled(x.astype(np.float64)))[1], -REACH, REACH)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Between 0 and 1; at THRESHOLD and above a document counts as positive."""
        return 1 / (1 + np.exp(-np.clip(raw + self.shift, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, modulus: int = 4, held: int = 2) -> PositiveUnlabelled | None:
    """A classifier from the rows outside the held-out fold, not yet calibrated; None where there is no positive.

    About fit_rows positives and as many unlabelled documents are used, those of the least
    hashes of their ids, and never more than twice as many; no other text is read. The
    prior is the share of label 1 among all labels of the folds that may be learnt from. A
    document that has several labels counts with each.
    """
    own = labels.where(fold_of("doc_id", modulus) != held).where("quality is not null").select("doc_id", "quality")
    total = own.agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("k")).first()
    if not total.k:
        return None
    prior = min(0.99, max(0.01, total.k / total.n))
    learn = docs.where(fold_of("doc_id", modulus) != held).select("doc_id", "text")

    def sample(rows: DataFrame, n: int) -> DataFrame:
        """Of n rows those whose ids hash low enough that about fit_rows remain."""
        low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, (fit_rows << 30) // max(n, 1)))
        return rows.where(F.coalesce(low, F.lit(True)))

    positive = learn.join(materialize(sample(own.where("quality = 1").select("doc_id").distinct(), total.k).limit(2 * fit_rows), "positives"), "doc_id")
    unlabelled = sample(learn, learn.count())
    # Bounded as features, not as texts, which would all go to one task.
    p, u = (np.array([list(r.features) for r in feature_rows(x).limit(2 * fit_rows).collect()], np.float64).reshape(-1, FEATURES) for x in (positive, unlabelled))
    if not len(p) or not len(u):
        return None
    # Sorted, so that the fit does not depend on the order in which rows came.
    return PositiveUnlabelled(prior).fit(p[np.lexsort(p.T)], u[np.lexsort(u.T)])


def _scored(docs: DataFrame, labels: DataFrame, fit_rows: int, *keep: str) -> tuple[DataFrame, PositiveUnlabelled | None]:
    """The columns in `keep`, held_out and raw of every row of docs, written, and the calibrated classifier; each text is read once for it."""
    model = fit_quality(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                raw = model.raw(_features(part.column("__text"))) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(raw)], [*part.schema.names[:-1], "__raw"])

    own = docs.select(*keep, (fold_of("doc_id", 4) == 2).alias("__held"), F.col("text").alias("__text"))
    schema = own.drop("__text").withColumn("__raw", F.lit(0.0)).schema
    rows = materialize(own.mapInArrow(run, schema), "scores")
    if model is not None:
        # At most 2 * REACH / CELL + 1 rows.
        cells = rows.where("not __held").groupBy(F.round(F.col("__raw") / CELL).cast("int").alias("cell")).count().collect()
        model.calibrate({r["cell"]: r["count"] for r in cells})
    return rows, model


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Only the features of the text make the score: rows of equal texts score alike; a null
    text is an empty one. Without a positive label to learn from every score is 0.5.
    A null doc_id is in fold 0. Repeated rows are scored each; other columns are not read.
    Either table may be empty.
    """
    rows, model = _scored(docs, labels, fit_rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("__raw").to_numpy()
            s = model.score(raw) if model else np.full(len(raw), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__held"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_rejected(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without those that the classifier scores under THRESHOLD; all columns stay as they are.

    Without a positive label nothing is known and nothing goes. Null texts are scored as
    empty ones; a null doc_id and repeated rows do not matter: rows of equal texts stay or
    go together. An empty table stays empty.
    """
    rows, model = _scored(docs, labels, fit_rows, *docs.columns)
    if model is None:
        return docs
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.score(batch.column("__raw").to_numpy()) >= THRESHOLD
            yield batch.select(columns).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)
