"""Benchmark decontamination by a distributed positional inverted index.

The index is stored: each row is a shard, the documents of one slice of a partition, with
its terms in order, how many postings each has, and all postings (places of words, counted
through the shard) by term. Shards hold whole documents, so neither texts nor postings are
shuffled, and a term in every document is one list per shard.

The benchmark's windows are looked up in every shard, by the terms' postings alone. How
rare a term is, the index says for the whole corpus. For each window the list of its
rarest term, moved by the term's place in the window, gives the places where the window
could begin; they are intersected with the list of the next rarest, moved likewise, and so
on: what is left are the exact phrases. Proximity matches are found by the same lists: an
occurrence of the rarest term near which, in the same document, all others stand too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, ranges, starts, text_slices
from graphloom.llm.simhash import text_hash

#: Words of a window, and how far from its rarest word all others are in a proximity match.
WINDOW, SLOP = 10, 15
#: Words of the benchmark that are sent to executors at a time, about; one block at a time.
BLOCK_WORDS = 1_000_000
#: Places that are intersected at a time.
CANDIDATES = 2_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def content_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of all texts, A-Z lower-cased, and how many each has."""
    parts = [x.as_py().translate(_TABLE).split() if x.is_valid else [] for x in text.cast(pa.binary())]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    return pa.array([w for p in parts for w in p], pa.binary()), count


def _squeezed(v: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Shard:
    """Sorted terms, and for each its postings, ascending; counts: how many words each document has."""

    def __init__(self, terms: pa.Array, sizes: np.ndarray, postings: np.ndarray, counts: np.ndarray):
        self.terms, self.sizes, self.postings, self.counts = terms, sizes, postings, counts
        self.begin, self.first = starts(counts), starts(sizes)
        self.ends = self.begin + counts
        # (term, place), ascending, and one that is greater than any.
        self.keys = np.append((np.repeat(np.arange(len(sizes)), sizes) << 32) | postings, np.int64(2**63 - 1))

    @classmethod
    def of(cls, text: pa.Array) -> Shard:
        words, counts = content_words(text)
        code = words.dictionary_encode()
        order = pc.array_sort_indices(code.dictionary).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        ids = number[code.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        return cls(code.dictionary.take(pa.array(order)), np.bincount(ids, minlength=len(order)), np.argsort(ids, kind="stable"), counts)

    def packed(self) -> tuple[bytes, bytes]:
        """Sizes and postings, the latter as steps from one to the next of a term."""
        step = np.diff(self.postings, prepend=0)
        step[self.first[self.sizes > 0]] = self.postings[self.first[self.sizes > 0]]
        return _squeezed(self.sizes), _squeezed(step)

    @classmethod
    def unpacked(cls, terms: pa.Array, sizes: bytes, postings: bytes, counts: bytes) -> Shard:
        sizes, step = _unsqueezed(sizes), _unsqueezed(postings)
        total = np.cumsum(step)
        before = np.r_[0, total][starts(sizes)]
        return cls(terms, sizes, total - np.repeat(before, sizes), _unsqueezed(counts))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), one row per shard: shard, ids, hashes (of the texts), counts, terms, sizes, postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch):
                own = Shard.of(part.column("text"))
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                sizes, postings = own.packed()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), one(part.column("doc_id")), one(part.column("h")), pa.array([_squeezed(own.counts)], pa.binary()), one(own.terms), pa.array([sizes], pa.binary()), pa.array([postings], pa.binary())],
                    ["shard", "ids", "hashes", "counts", "terms", "sizes", "postings"],
                )
                shard += 1

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", text_hash().alias("h")).mapInArrow(run, f"shard long, ids array<{kind}>, hashes array<long>, counts binary, terms array<binary>, sizes binary, postings binary")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Shard]]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch, r, Shard.unpacked(batch.column("terms")[r].values, *(batch.column(c)[r].as_py() for c in ("sizes", "postings", "counts")))


class Phrases:
    """The distinct windows of items, as rows of term numbers (-1 beyond their end), with the terms of each by rarity."""

    def __init__(self, ids: list[str], texts: list[str | None], n: int = WINDOW):
        words, count = content_words(pa.array(texts, pa.string()))
        self.vocabulary = pc.unique(words).sort() if len(words) else words
        terms = np.append(pc.index_in(words, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64), np.full(n, -1))
        windows = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
        at, length = ranges(starts(count), windows), np.repeat(np.minimum(count, n), windows)
        every = np.where(np.arange(n) < length[:, None], terms[at[:, None] + np.arange(n)], -1)
        self.windows, which = np.unique(every, axis=0, return_inverse=True) if len(at) else (every, np.zeros(0, np.int64))
        self.length = (self.windows >= 0).sum(axis=1)
        owner = np.unique(np.stack([which.ravel(), np.repeat(np.arange(len(ids)), windows)], axis=1), axis=0).reshape(-1, 2)
        # Items by window: equal windows are searched for once.
        self.item, self.items_of = owner[:, 1], np.bincount(owner[:, 0], minlength=len(self.windows))
        self.item_ids = np.array(ids, object)
        self.ranked(np.zeros(len(self.vocabulary), np.int64))

    def ranked(self, frequency: np.ndarray) -> None:
        """Order each window's places by the corpus frequency of their terms, of equal ones by the term and then the place."""
        most = int(frequency.max(initial=0)) + 1
        key = np.where(self.windows >= 0, frequency[self.windows] * len(self.vocabulary) + self.windows, most * max(1, len(self.vocabulary))) if len(self.vocabulary) else self.windows
        self.rank = np.argsort(key, axis=1, kind="stable")

    def search(self, shard: Shard, slop: int = SLOP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window and first place of every exact occurrence; window and place of the rarest term of every proximity match."""
        none = np.zeros(0, np.int64)
        found = [[none], [none], [none], [none]]
        if len(self.vocabulary) and len(shard.postings):
            number = pc.fill_null(pc.index_in(self.vocabulary, shard.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = np.where(self.windows >= 0, number[self.windows], 0)
            own = np.flatnonzero((term >= 0).all(axis=1))  # no term of theirs is without postings here
            many = shard.sizes[term[own, self.rank[own, 0]]]
            block = np.cumsum(many) // CANDIDATES
            for k in np.unique(block):
                some = own[block == k]
                rarest = term[some, self.rank[some, 0]]
                w = np.repeat(some, shard.sizes[rarest])
                p = shard.postings[ranges(shard.first[rarest], shard.sizes[rarest])]
                doc = np.searchsorted(shard.ends, p, side="right")
                low, high = shard.begin[doc], shard.ends[doc]
                for o, v in zip(found, (*self._exact(shard, term, w, p, low, high), *self._near(shard, term, w, p, low, high, slop))):
                    o.append(v)
        return tuple(np.concatenate(o) for o in found)

    def _exact(self, shard: Shard, term: np.ndarray, w: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = p - self.rank[w, 0]
        keep = (start >= low) & (start + self.length[w] <= high)
        w, start = w[keep], start[keep]
        for k in range(1, self.rank.shape[1]):
            place = self.rank[w, k]
            key = (term[w, place] << 32) | (start + place)
            keep = (shard.keys[np.searchsorted(shard.keys, key)] == key) | (k >= self.length[w])
            w, start = w[keep], start[keep]
        return w, start

    def _near(self, shard: Shard, term: np.ndarray, w: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.maximum(low, p - slop), np.minimum(high - 1, p + slop)
        for k in range(1, self.rank.shape[1]):
            t = term[w, self.rank[w, k]] << 32
            keep = (shard.keys[np.searchsorted(shard.keys, t | low)] <= (t | high)) | (k >= self.length[w])
            w, p, low, high = w[keep], p[keep], low[keep], high[keep]
        return w, p

    def owners(self, doc: np.ndarray, window: np.ndarray, docs: int) -> list[list[str]]:
        """The ids of the items that have these windows, sorted, for each document."""
        pair = np.unique(doc * max(1, len(self.windows)) + window)
        doc, window = np.divmod(pair, max(1, len(self.windows)))
        item = self.item[ranges(starts(self.items_of)[window], self.items_of[window])]
        doc = np.repeat(doc, self.items_of[window])
        out: list[set[str]] = [set() for _ in range(docs)]
        for d, i in zip(doc.tolist(), item.tolist()):
            out[d].add(self.item_ids[i])
        return [sorted(x) for x in out]


def _term_counts(index: DataFrame, phrases: Phrases) -> np.ndarray:
    """How many postings each term of the phrases has in all shards: one sum for each."""
    sent = index.sparkSession.sparkContext.broadcast(phrases.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column("terms"), batch.column("sizes")):
                at = pc.index_in(sent.value, terms.values)
                has = pc.is_valid(at).to_numpy(zero_copy_only=False)
                total[has] += _unsqueezed(sizes.as_py())[pc.drop_null(at).to_numpy(zero_copy_only=False)]
        has = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(total[has], pa.int64())], ["term", "n"])

    out = np.zeros(len(phrases.vocabulary), np.int64)
    if len(out):
        for r in index.select("terms", "sizes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r.term] = r.n
    sent.unpersist()
    return out


_HITS = "shard long, at int, h long, n_words long, places binary, items array<string>, near array<string>"


def _searched(index: DataFrame, phrases: Phrases, slop: int) -> tuple[DataFrame, object]:
    """Per document: its shard and place there, h, n_words, which words are hit (packed bits), items, near; and what was broadcast."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, r, shard in _shards(batches):
            w, start, near_w, near_p = sent.value.search(shard, slop)
            edge = np.zeros(int(shard.counts.sum()) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + sent.value.length[w], -1)
            hit = np.cumsum(edge[:-1]) > 0
            n = len(shard.counts)
            some = np.r_[0, np.cumsum(hit)]
            many = some[shard.ends] - some[shard.begin]
            places = [np.packbits(hit[a:b]).tobytes() if k else b"" for a, b, k in zip(shard.begin.tolist(), shard.ends.tolist(), many.tolist())]
            lists = [sent.value.owners(np.searchsorted(shard.ends, at, side="right"), own, n) for own, at in ((w, start), (near_w, near_p))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column("shard")[r].as_py())), pa.array(np.arange(n), pa.int32()), batch.column("ids")[r].values, batch.column("hashes")[r].values, pa.array(shard.counts), pa.array(places, pa.binary()), *(pa.array(x, pa.list_(pa.string())) for x in lists)],
                ["shard", "at", "doc_id", "h", "n_words", "places", "items", "near"],
            )

    return index.mapInArrow(run, _HITS.replace("h long", f"doc_id {kind}, h long")), sent


def phrase_hits(index: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document of the index: doc_id, h, n_words, places, items, near (see _searched) for the windows of benchmark.

    The benchmark is searched for in blocks of about block_words words (of at least one
    item each), one after another; with more than one, each block's result is written
    before the next is sent, and a document's results are then united.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-words // (5 * block_words)))  # a word and the space after it are five letters at least, nearly always
    found = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        rows = sorted(((str(r.id), r.text) for r in own.collect()), key=lambda r: (r[0], r[1] or ""))
        phrases = Phrases([i for i, _ in rows], [t for _, t in rows], n)
        phrases.ranked(_term_counts(index, phrases))
        out, sent = _searched(index, phrases, slop)
        if blocks == 1:
            return out
        found.append(materialize(out, "hits"))
        sent.unpersist()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for lists in batch.column("places").to_pylist():
                out = np.zeros(max(map(len, lists), default=0), np.uint8)
                for x in lists:
                    out[: len(x)] |= np.frombuffer(x, np.uint8)
                places.append(out.tobytes())
            lists = [[sorted({i for x in v for i in x}) for v in batch.column(c).to_pylist()] for c in ("items", "near")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "n_words")), pa.array(places, pa.binary()), *(pa.array(x, pa.list_(pa.string())) for x in lists)], ["doc_id", "h", "n_words", "places", "items", "near"])

    one = every.groupBy("shard", "at").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("n_words").alias("n_words"), *(F.collect_list(c).alias(c) for c in ("places", "items", "near")))
    kind = dict(every.dtypes)["doc_id"]
    return one.drop("shard", "at").mapInArrow(unite, f"doc_id {kind}, h long, n_words long, places binary, items array<string>, near array<string>")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items for every row of docs.

    A window is n consecutive words of an item, or a whole shorter item that has words;
    a word inside any occurrence of a window is hit, and overlaps count once. n_near_items:
    items with a window of which the rarest word (in docs; of equal ones the least) stands
    somewhere with all others within `slop` words, in any order. Null texts have no words;
    items without words have no window. Items that share an item_id count once. A null
    doc_id is kept; a null item_id is called 'None'. Repeated rows are searched each.
    Either table may be empty. Other columns are not read.
    """
    hits = phrase_hits(materialize(build_index(docs), "index"), benchmark, n, slop, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.array([int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in batch.column("places").to_pylist()], np.int64)
            items = batch.column("items").to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            near = [len(x) for x in batch.column("near").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(many), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(many > 0), pa.array(near, pa.int64())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return hits.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; all columns stay as they are.

    Rows go by their text (its 64-bit hash), so repeated texts go together and a null
    doc_id is no matter. Null and empty texts have no words and stay. Proximity alone
    drops nothing. Either table may be empty.
    """
    hits = phrase_hits(materialize(build_index(docs), "index"), benchmark, n, 0, block_words)
    gone = materialize(hits.where("size(items) > 0").select(F.col("h").alias("__gone")).distinct(), "contaminated")
    return docs.withColumn("__gone", text_hash()).join(gone, "__gone", "left_anti").select(*docs.columns)


def phrase_matches(index: DataFrame, phrase: list[str], slop: int | None = None) -> DataFrame:
    """doc_id, start of a phrase in a stored index; with slop, the places of its rarest word that have all others within so many words."""
    if not phrase:
        raise ValueError("a phrase needs a word")
    phrases = Phrases(["phrase"], [" ".join(phrase)], len(phrase))
    if phrases.windows.shape[0] != 1 or phrases.length[0] != len(phrase):
        raise ValueError("each word of a phrase is one word")
    phrases.ranked(_term_counts(index, phrases))
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, r, shard in _shards(batches):
            _, start, _, near = sent.value.search(shard, slop or 0)
            at = np.sort(start if slop is None else near)
            doc = np.searchsorted(shard.ends, at, side="right")
            yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values.take(pa.array(doc)), pa.array(at - shard.begin[doc])], ["doc_id", "start"])

    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return index.mapInArrow(run, f"doc_id {kind}, start long")
