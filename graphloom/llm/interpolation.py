"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context frequency.

P(w | h) = l2(b) c(h,w)/c(h) + l1(b) c(w)/N + l0(b) / (V + 1), where b is the bucket of
c(h), its binary logarithm, and a context that was never seen has no l2. The weights of
each bucket are learned by expectation-maximisation on the counts of a deleted part of
the training texts, against counts of the rest; the estimates then come from all of it.

How it is laid out. Texts are tokenised once, into blocks of some megabytes written to
the shared folder: a block holds its documents' token numbers and its vocabulary. Each
block sends its distinct word and bigram hashes with counts, sorted and packed, to the
hash's bucket; a bucket sums them and answers each block in the order of the block's own
keys, counts alone. So what is shuffled is distinct n-grams per block, never token
positions, a frequent n-gram is one entry per block, and no table is held whole anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, materialize, split_words, starts, text_slices

#: Bytes of text in a block, about: a Python worker holds some forty times as much at most.
BLOCK_BYTES = 5 << 20
#: n-gram hashes in a bucket, about.
BUCKET_KEYS = 1_000_000
KEPT, DELETED, HELD_OUT = 0, 1, 2
CONTEXTS = 40
_END, _BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = 16  # histogram cells per doubling of a ratio
_ZERO, _NONE = 1 << 18, -(1 << 18)  # where a ratio of one stands among the cells; an estimate of zero


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD
        x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h * np.uint64(3) + np.uint64(0x5851F42D4C957F2D) + _mix(w))


class Block:
    """Documents as runs of indices into a sorted vocabulary of 64-bit word hashes; each run ends with the end token."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, counts: np.ndarray):
        self.vocabulary, self.tokens, self.counts = vocabulary, tokens, counts

    @classmethod
    def of(cls, slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Block:
        """From (hashes of a slice's distinct words, word numbers, tokens per document) each."""
        vocabulary = np.unique(np.concatenate([x[0] for x in slices]))
        tokens = np.concatenate([np.searchsorted(vocabulary, h)[t] for h, t, _ in slices]).astype(np.uint32)
        return cls(vocabulary, tokens, np.concatenate([x[2] for x in slices]))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct bigram hashes, how often each stands here, and each token's bigram."""
        word = self.vocabulary[self.tokens]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[starts(self.counts)] = _BEGIN
        keys, at, n = np.unique(_pair(before, word), return_inverse=True, return_counts=True)
        return keys, n, at

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.vocabulary.astype("<u8").tobytes(), zlib.compress(np.stack([(self.tokens >> np.uint32(8 * i)).astype(np.uint8) for i in range(4)]).tobytes(), 1), self.counts.astype("<u4").tobytes()

    @classmethod
    def unpacked(cls, vocabulary: bytes, tokens: bytes, counts: bytes) -> Block:
        planes = np.frombuffer(zlib.decompress(tokens), np.uint8).reshape(4, -1).astype(np.uint32)
        return cls(np.frombuffer(vocabulary, "<u8"), sum(planes[i] << np.uint32(8 * i) for i in range(4)), np.frombuffer(counts, "<u4").astype(np.int64))


def _slice(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, count = split_words(pc.ascii_lower(pc.fill_null(text, "")))
    code = words.dictionary_encode()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(code.dictionary))
    tokens = np.insert(code.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(count), len(h))
    return np.append(h, _END), tokens, count + 1


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as differences, each of as many bytes as the greatest needs; the first byte says how many."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step[1:].max()).bit_length() + 7) // 8) if len(step) > 1 else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(rest) + 1, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8, 1)
    step[1:, :width] = rest
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def token_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of docs (doc_id, text, fold): block, fold, ids, vocabulary, tokens, counts, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def out(fold: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(fold)
            size.pop(fold)
            block = Block.of([x[1] for x in rows])
            v, t, c = block.packed()
            made += 1
            ids = pa.concat_arrays([x[0] for x in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) | made], pa.int64()), pa.array([fold], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v], pa.binary()), pa.array([t], pa.binary()), pa.array([c], pa.binary()), pa.array([len(block.tokens)], pa.int64())],
                ["block", "fold", "ids", "vocabulary", "tokens", "counts", "n_tokens"],
            )

        for batch in batches:
            for fold in pc.unique(batch.column("fold")).to_pylist():
                for part in text_slices(batch.filter(pc.equal(batch.column("fold"), fold))):
                    held.setdefault(fold, []).append((part.column("doc_id"), _slice(part.column("text"))))
                    size[fold] = size.get(fold, 0) + part.column("text").nbytes
                    if size[fold] >= block_bytes:
                        yield out(fold)
        for fold in sorted(held):
            yield out(fold)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "fold").mapInArrow(run, f"block long, fold int, ids array<{kind}>, vocabulary binary, tokens binary, counts binary, n_tokens long")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash by its leading bits, so that sorted keys lie in runs."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row for each block and bucket: the block's sorted keys there, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block.unpacked(*(batch.column(c)[r].as_py() for c in ("vocabulary", "tokens", "counts")))
                bigrams, n2, _ = block.bigrams()
                rows = []
                for order, keys, n in ((1, block.vocabulary, np.bincount(block.tokens, minlength=len(block.vocabulary))), (2, bigrams, n2)):
                    cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                    for b in np.nonzero(np.diff(cuts))[0].tolist():
                        own = slice(cuts[b], cuts[b + 1])
                        rows.append((b, order, _packed_keys(keys[own]), zlib.compress(n[own].astype("<u4").tobytes(), 1)))
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, batch.column("block")[r].as_py())), pa.array(np.full(k, batch.column("fold")[r].as_py()), pa.int32()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[3] for x in rows], pa.binary())],
                    ["block", "fold", "bucket", "order", "keys", "n"],
                )

    return blocks.select("block", "fold", "vocabulary", "tokens", "counts").mapInArrow(run, "block long, fold int, bucket int, order int, keys binary, n binary")


def _answer(table: pa.Table) -> pa.Table:
    """For one bucket and order: each block's keys' counts in the kept and in the deleted part; and how many keys training has."""
    fold = table["fold"].to_pylist()
    keys = [_unpacked_keys(x.as_py()) for x in table["keys"]]
    n = [np.frombuffer(zlib.decompress(x.as_py()), "<u4").astype(np.int64) if f != HELD_OUT else None for x, f in zip(table["n"], fold)]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = {KEPT: np.zeros(len(every), np.int64), DELETED: np.zeros(len(every), np.int64)}
    p, places = 0, []
    for k, c, f in zip(keys, n, fold):
        places.append(at[p : p + len(k)])
        p += len(k)
        if c is not None:
            total[f][places[-1]] += c  # a block's keys are distinct
    known = int((total[KEPT] + total[DELETED] > 0).sum())
    pack = lambda v: zlib.compress(v.astype("<u4").tobytes() if not len(v) or v.max() < 1 << 32 else b"\1" + v.astype("<u8").tobytes(), 1)  # noqa: E731  a leading byte marks wide counts
    columns = {
        "block": table["block"], "fold": table["fold"], "bucket": table["bucket"], "order": table["order"],
        "kept": pa.array([pack(total[KEPT][x]) for x in places], pa.binary()), "deleted": pa.array([pack(total[DELETED][x]) for x in places], pa.binary()),
        "types": pa.array([known if i == 0 else 0 for i in range(len(places))], pa.int64()),
    }
    return pa.table(columns)


def _wide(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    return np.frombuffer(data, "<u8", offset=1).astype(np.int64) if len(data) % 4 else np.frombuffer(data, "<u4").astype(np.int64)


class Counts:
    """Counts of a block's words and bigrams in a part of the training texts."""

    def __init__(self, block: Block, word: np.ndarray, bigram: np.ndarray, starts_: int, at: np.ndarray):
        context = np.empty(len(block.tokens), np.int64)
        w = word[block.tokens]
        context[1:] = w[:-1]
        context[starts(block.counts)] = starts_
        # A word's count as a context is its count: each is followed by something.
        self.word, self.bigram, self.context = w, bigram[at], context


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2 of its count)."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), CONTEXTS - 1), 0).astype(np.int64)


def components_of(c: Counts, total: int, types: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The estimates that are mixed: by bigram, by word, uniform."""
    return c.bigram / np.maximum(c.context, 1), c.word / max(total, 1), 1.0 / (types + 1)


def _joined(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    per_block = counts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("order", "bucket", "kept", "deleted"))).alias("answers"))
    return blocks.join(per_block, "block")


def _unpack(batch: pa.RecordBatch, r: int) -> tuple[Block, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    block = Block.unpacked(*(batch.column(c)[r].as_py() for c in ("vocabulary", "tokens", "counts")))
    answers = batch.column("answers")[r].as_py()
    parts: dict[int, list] = {1: [[], []], 2: [[], []]}
    for x in answers:
        parts[x["order"]][0].append(_wide(x["kept"]))
        parts[x["order"]][1].append(_wide(x["deleted"]))
    kept, deleted = ([np.concatenate(parts[o][i]) for o in (1, 2)] for i in (0, 1))
    return block, block.bigrams()[2], kept, deleted


def learn_weights(cells: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """Weights (bigram, word, uniform) of each context bucket, by expectation-maximisation.

    cells: bucket, round(16 log2(p2 / p0)) or _NONE where p2 is 0, the same of p1 (either may
    be below 0: a word that is rarer than uniform), and how many held-out tokens are so.
    Likelihood ratios are all that the expectations need. Buckets that no held-out token is
    in take the weights of the nearest one that has some.
    """
    weights = np.full((CONTEXTS, 3), np.nan)
    data = np.array(cells, np.float64).reshape(-1, 4)
    for b in np.unique(data[:, 0]).astype(int).tolist():
        own = data[data[:, 0] == b]
        ratio = np.stack([*(np.where(own[:, i] == _NONE, 0.0, 2.0 ** (own[:, i] / _STEP)) for i in (1, 2)), np.ones(len(own))], axis=1)
        m = own[:, 3] / own[:, 3].sum()
        w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        for _ in range(rounds):
            joint = ratio * w
            new = (m[:, None] * joint / joint.sum(axis=1, keepdims=True)).sum(axis=0)
            done = np.abs(new - w).max() < 1e-9
            w = new
            if done:
                break
        # The uniform part never vanishes, so a word that was never seen has a probability.
        w = np.maximum(w, [0.0, 0.0, 1e-6])
        weights[b] = w / w.sum()
    have = np.nonzero(~np.isnan(weights[:, 0]))[0]
    for b in range(CONTEXTS):
        if np.isnan(weights[b, 0]):
            near = have[have > 0] if b else have[:0]
            weights[b] = weights[near[np.argmin(np.abs(near - b))]] if len(near) else ([0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3)
    return weights


def interpolated_scores(docs: DataFrame, fold, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    fold: a column over docs, KEPT, DELETED (both are learnt from) or HELD_OUT. Texts'
    A-Z are lower-cased; tokens are words between white space and one end a text, so a null
    or blank text has one token. Without training texts every word is unknown and both
    scores are those of the uniform distribution. Repeated rows count and are scored each;
    other columns are not read; an empty table gives an empty result.
    """
    blocks = materialize(token_blocks(docs.select("doc_id", "text", fold.cast("int").alias("fold")), block_bytes), "blocks")
    sizes = {r.fold: r for r in blocks.groupBy("fold").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.size("ids")).alias("docs")).collect()}
    tokens = [sizes[f].tokens if f in sizes else 0 for f in (KEPT, DELETED)]
    texts = [sizes[f].docs if f in sizes else 0 for f in (KEPT, DELETED)]
    buckets = max(1, -(-sum(r.tokens for r in sizes.values()) // bucket_keys))
    asked = _asked(blocks, buckets)
    answered = asked.groupBy("bucket", "order").applyInArrow(_answer, "block long, fold int, bucket int, order int, kept binary, deleted binary, types long")
    counts = materialize(answered, "counts")
    types = counts.where("order = 1").agg(F.sum("types")).first()[0] or 0
    kept_tokens, kept_texts = tokens[0], texts[0]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block, at, kept, _ = _unpack(batch, r)
                c = Counts(block, kept[0], kept[1], kept_texts, at)
                p2, p1, p0 = components_of(c, kept_tokens, types)
                cell = [np.where(p > 0, np.round(_STEP * np.log2(np.maximum(p, 1e-300) / p0)), _NONE).astype(np.int64) + _ZERO for p in (p2, p1)]
                code, n = np.unique((bucket_of(c.context) << 40) | (cell[0] << 20) | cell[1], return_counts=True)
                for k, v in zip(code.tolist(), n.tolist()):
                    total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cell", "n"])

    # The histogram has CONTEXTS times some hundred squared cells at most, whatever the corpus.
    deleted = _joined(blocks.where(F.col("fold") == DELETED), counts.where(F.col("fold") == DELETED))
    cells = [(r.cell >> 40, ((r.cell >> 20) & 0xFFFFF) - _ZERO, (r.cell & 0xFFFFF) - _ZERO, r.n) for r in deleted.mapInArrow(expect, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()]
    weights = learn_weights(cells)
    train_tokens, train_texts = sum(tokens), sum(texts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, at, kept, cut = _unpack(batch, r)
                c = Counts(block, kept[0] + cut[0], kept[1] + cut[1], train_texts, at)
                p2, p1, p0 = components_of(c, train_tokens, types)
                w = weights[bucket_of(c.context)]
                first = starts(block.counts)
                total = np.add.reduceat(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0), first)
                base = np.add.reduceat(np.log10((c.word + 0.5) / (train_tokens + 0.5 * (types + 1))), first)
                known = np.add.reduceat((c.word > 0).astype(np.int64), first)
                n = len(first)
                held = batch.column("fold")[r].as_py() == HELD_OUT
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, pa.array(np.full(n, held)), pa.array(block.counts), pa.array(known), pa.array(np.full(n, train_tokens, np.int64)), pa.array(base), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return _joined(blocks, counts).mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def document_folds(doc_id: str = "doc_id"):
    """Held out: remainder 1 of crc32 mod 5; deleted from training for the weights: remainder 4."""
    rest = fold_of(doc_id, 5)
    return F.when(rest == 1, HELD_OUT).when(rest == 4, DELETED).otherwise(KEPT)
