"""Best-fit packing of tokenised documents into fixed-length sequences, by vectors.

A piece asks for (tokens, one document, attention cost = length squared) of a sequence's
capacities, and goes, longest first, to the open sequence that fits under every
constraint and scores best: least weighted norm of what would be left over ("norm"), or
largest weighted dot product of demand and residual ("dot").

Pieces of one length ask for the same vector, so the choice is made on the counts of
lengths, at most `capacity` numbers whatever the corpus: the plan says, for each run of
ranks among the pieces of one length, which sequences take them. A second pass ranks the
pieces (a count for each task and length, no sort of the corpus) and applies the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, ranges, split_words, starts, text_slices

SEQUENCE = 2048
#: Words whose ids a Python worker remembers at most.
REMEMBERED = 300_000


class WordIds:
    """Token ids of texts: white-space-separated chunks are encoded once each and remembered.

    The tokenizer's own split never joins characters across white space, so the ids of a
    text are those of its chunks in a row. To meet fewer distinct chunks, texts are
    lower-cased (A-Z, as the tokenizer does) and parted between a letter and the
    punctuation after it, where the tokenizer parts them too. Texts for which that could
    matter, with a special token's "<|" or combining marks, are left as they are.
    """

    CARE = r"<\||[\x{0300}-\x{036F}]"
    PART = r"([a-z])([.,!|*$%&#?;:])"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.lstrip and not t.rstrip and not t.single_word and not t.normalized]
        self.mark_id, self.mark = max(special, default=(-1, ""))

    def _learn(self, new: list[str]) -> None:
        """Encode words, hundreds at a time with the special token between them, which ends every word."""
        plain = [w for w in new if self.mark and self.mark not in w]
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            ids = np.array(self.tokenizer.encode(self.mark.join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.nonzero(ids == self.mark_id)[0].tolist()
            data = ids.tobytes()
            for w, x, y in zip(some, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]):
                self.known[w] = data[4 * x : 4 * y]
        for w in new:
            if w not in self.known:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def _prepared(self, text: pa.Array) -> pa.Array:
        text = pc.fill_null(text, "")
        plain = pc.replace_substring_regex(pc.ascii_lower(text), self.PART, r"\1 \2")
        return pc.if_else(pc.match_substring_regex(text, self.CARE), text, plain)

    def ids(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text closed by `end`, and how many each has."""
        words, count = split_words(self._prepared(text))
        code = words.dictionary_encode()
        distinct = code.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:  # those of this text, which hold the frequent ones, stay
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        new = [w for w in distinct if w not in self.known]
        self._learn(new)
        lists = [*map(self.known.__getitem__, distinct), np.array([end], "<u4").tobytes()]
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        flat, at = np.frombuffer(b"".join(lists), "<u4"), starts(size)
        word = np.insert(code.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(count), len(distinct))
        out = flat[ranges(at[word], size[word])]
        own = np.add.reduceat(size[word], starts(count + 1)) if len(count) else np.zeros(0, np.int64)
        return out, own


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of this Python worker."""
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


_PIECES = "piece int, start long, length long, ids_crc32 long, __task int, __rank long"


def pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its rank among its task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in text_slices(batch):
                ids, total = word_ids(path).ids(part.column("text"), end)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), n)
                piece = ranges(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                at = starts(total)[doc] + start
                data = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                kind, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = ranges(used[kind], many)
                used[kind] += many
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "__task", "__rank"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_PIECES}")


def plan_best_fit(counts: dict[int, int], capacities: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm") -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset), by length and rank.

    counts: how many pieces there are of each length. capacities: tokens, documents and
    attention cost (sum of squared lengths) that a sequence holds. Pieces that no empty
    sequence holds raise ValueError.
    """
    cap = np.array(capacities, np.float64)
    w = np.array(weights, np.float64)
    rest = np.zeros((1024, 3))  # residual capacities of each kind of open sequence
    runs: list[list[tuple[int, int]]] = []  # and the sequences that are of this kind
    kind_of: dict[tuple, int] = {}
    size = np.zeros(1024, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(residual: np.ndarray, a: int, b: int) -> None:
        nonlocal rest, size
        if residual[0] < 1 or a >= b:
            return
        key = tuple(residual.tolist())
        k = kind_of.get(key)
        if k is None:
            k = kind_of[key] = len(runs)
            runs.append([])
            if k >= len(rest):
                rest, size = np.concatenate([rest, np.zeros_like(rest)]), np.concatenate([size, np.zeros_like(size)])
            rest[k] = residual
        runs[k].append((a, b))
        size[k] += b - a

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], np.float64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits in no sequence")
        while left:
            n = len(runs)
            fits = np.nonzero((size[:n] > 0) & (rest[:n] >= need).all(axis=1))[0]
            if len(fits):
                r = rest[fits]
                value = (w * ((r - need) / cap) ** 2).sum(axis=1) if score == "norm" else -(w * (r / cap) * (need / cap)).sum(axis=1)
                k = int(fits[np.argmin(value)])
                residual = rest[k].copy()
            else:
                k, residual = -1, cap.copy()
            each = int((residual // need).min()) if score == "norm" else 1
            want = -(-left // each)
            if k < 0:
                a, b = opened, opened + want
                opened = b
            else:
                a, b = runs[k].pop()
                size[k] -= b - a
                if b - a > want:
                    put(residual, a + want, b)
                    b = a + want
            full = min(b - a, left // each)
            offset = int(cap[0] - residual[0])
            if full:
                out.append((length, rank, a, each, offset))
                rank, left = rank + full * each, left - full * each
                put(residual - each * need, a, a + full)
            if full < b - a and left:  # the last sequence takes fewer
                out.append((length, rank, a + full, each, offset))
                put(residual - left * need, a + full, a + full + 1)
                rank, left = rank + left, 0
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = SEQUENCE, max_documents: int | None = None, max_attention: int | None = None, score: str = "norm", end: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, attention_cost.

    A document's ids are its text's by the tokenizer file at `path` and then `end`; only
    longer ones than `capacity` are cut. max_documents and max_attention (sum of squared
    lengths) bound a sequence too; by default they are what `capacity` tokens can need at
    most, so that as few sequences as can be are used. A null or blank text is the id
    `end` alone. Repeated rows are packed each; other columns are not read. Sequences are
    numbered from 0, offsets are gapless from 0. An empty table gives an empty result.
    """
    own = materialize(pieces(docs, path, capacity, end), "pieces")
    per_task = own.groupBy("__task", "length").count()
    before = per_task.withColumn("__base", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_best_fit(counts, (capacity, max_documents or capacity, max_attention or capacity * capacity), score=score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy() + batch.column("__base").to_numpy()
            most = np.int64(1) << 40
            row = np.searchsorted(plan[:, 0] * most + plan[:, 1], length * most + rank, side="right") - 1
            step = rank - plan[row, 1]
            each = plan[row, 3]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(plan[row, 2] + step // each), pa.array(plan[row, 4] + step % each * length), pa.array(length * length)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "attention_cost"])

    ranked = own.join(before.select("__task", "length", "__base"), ["__task", "length"])
    return ranked.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, attention_cost long")
