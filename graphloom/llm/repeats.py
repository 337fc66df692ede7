"""Removal of every byte that a long repeated string covers, exactly and over the whole corpus.

A string of LENGTH bytes is repeated if it starts anywhere else too. Each such window
names an anchor: of its GRAM-byte substrings the one of least hash, the rightmost of equal
ones. Equal windows name equal anchors in the same place, so:

1. Windows that share an anchor are a run. Runs, as (anchor hash, run hash), are counted
   over the corpus; a run that occurs twice is repeated as a whole.
2. Only where an anchor occurs twice in runs that differ (at the ends of a shared
   passage, or around an edit) the windows themselves are compared: the strings of the
   different runs of an anchor, one occurrence of each, are sorted by their suffixes, by
   groups of Lyndon prefixes (suffix_groups.py).
3. Each document unites what its repeated windows cover.

Counts go through packed, sorted keys per block of documents: a block asks about its
different runs, saying which it holds twice, and the bucket of the hash answers in the
block's order. So a passage in a third of all documents is one entry per block. Where it has thousands of different surroundings, its windows are counted
one by one instead, by 64-bit hashes that any number of tasks share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, ranges, starts
from graphloom.llm.suffix_groups import repeated_starts

LENGTH, GRAM = 200, 112
#: Characters of text in a block, about; windows that a worker hashes at a time; keys in a bucket, about.
BLOCK_CHARS, CHUNK, BUCKET_KEYS = 4_000_000, 1 << 19, 1_000_000
#: Different runs of one anchor that are sorted in one task at most; a run is of some hundred bytes.
MOST_RUNS = 1024
_BASE, _ODD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    have = max(_TABLES, default=0)
    if have < n:
        _TABLES.clear()
        out = []
        with np.errstate(over="ignore"):
            for x in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
        _TABLES[n] = tuple(out)
        have = n
    return _TABLES[have]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD
        x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Hashes of the windows that start in data[at : at + CHUNK]."""

    def __init__(self, data: np.ndarray, at: int, length: int):
        self.at, self.own = at, data[at : at + CHUNK + length - 1]
        n = len(self.own)
        power, self.inverse = _powers(CHUNK + length)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[self.own] * power[:n], out=self.sums[1:])

    def hashes(self, first: np.ndarray, size) -> np.ndarray:
        """Of the strings that begin at `first` (from the chunk's start on) and have these sizes."""
        with np.errstate(over="ignore"):
            return _mix((self.sums[first + size] - self.sums[first]) * self.inverse[first])

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Each window's anchor, from the chunk's start on, and all substrings' hashes."""
        n, w = len(self.own), length - gram + 1
        with np.errstate(over="ignore"):
            h = _mix((self.sums[gram:] - self.sums[:-gram]) * self.inverse[: n - gram + 1])
        low = np.uint64((1 << 24) - 1)
        m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        s = 1
        while 2 * s <= w:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        if s < w:
            m = np.minimum(m[: len(m) - (w - s)], m[w - s :])
        return (low - (m & low)).astype(np.int64), h


class Texts:
    """Documents' bytes in a row and the runs of their windows."""

    def __init__(self, raw: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = starts(self.size)
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def chunks(self) -> Iterator[Chunk]:
        for at in range(0, len(self.data) - self.length + 1, CHUNK):
            yield Chunk(self.data, at, self.length)

    def runs(self) -> tuple[np.ndarray, ...]:
        """first window, number of windows, anchor's place, anchor's hash, run's hash of every run."""
        out = [[] for _ in range(5)]
        many = np.maximum(self.size - self.length + 1, 0)
        for c in self.chunks():
            x, h = c.anchors(self.length, self.gram)
            edge = np.zeros(len(x) + 1, np.int64)
            a = np.clip(self.begin - c.at, 0, len(x))
            b = np.clip(self.begin + many - c.at, 0, len(x))
            np.add.at(edge, a[b > a], 1)
            np.add.at(edge, b[b > a], -1)
            inside = np.cumsum(edge[:-1]) > 0
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (inside[1:] != inside[:-1])
            new[a[(a < len(x)) & (b > a)]] = True
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(x))
            keep = inside[first]
            first, last = first[keep], last[keep]
            place, n = x[first], last - first
            with np.errstate(over="ignore"):
                run = _mix(c.hashes(first, n - 1 + self.length) + (place - first).astype(np.uint64) * _ODD + (n.astype(np.uint64) << np.uint64(48)))
            # A least hash is a small one: mixed once more, so that buckets by leading bits are even.
            for o, v in zip(out, (first + c.at, n, place + c.at, _mix(h[place] ^ _ODD), run)):
                o.append(v)
        return tuple(np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, (np.int64, np.int64, np.int64, np.uint64, np.uint64)))

    def windows(self, place: np.ndarray) -> np.ndarray:
        """Hashes of the windows at these ascending places."""
        out, p = np.zeros(len(place), np.uint64), 0
        for c in self.chunks():
            q = int(np.searchsorted(place, c.at + CHUNK))
            if q > p:
                out[p:q] = c.hashes(place[p:q] - c.at, self.length)
            p = q
        return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the keys, and (bucket, from, to) of each bucket that has some in that order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.searchsorted(_bucket(keys[order], buckets), np.arange(buckets + 1))
    return order, [(b, int(cuts[b]), int(cuts[b + 1])) for b in np.nonzero(np.diff(cuts))[0].tolist()]


def _distinct_runs(anchor: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's different runs by anchor: the place of one of each, which of them each run is, and whether it is there twice."""
    order = np.lexsort((run, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (run[order[1:]] != run[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return first, which, np.bincount(which, minlength=len(first)) > 1


def _five(keys: np.ndarray) -> bytes:
    """The leading five bytes of each hash. Anchors that share them are only asked about more closely."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.uint64)


def _judge_runs(table: pa.Table, most: int) -> pa.Table:
    """Per different run of a block: 0 its anchor is unique, 1 repeated and all runs of its anchor alike, 2 repeated, 3 unique among others, 4 repeated and to stand for its like.

    5 and 6 are 3 and 4 of an anchor with more than `most` different runs.
    """
    anchor = [_from_five(x.as_py()) for x in table["keys"]]
    run = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table["runs"]])
    size = [len(x) for x in anchor]
    # A run that a block holds twice counts as two.
    many = 1 + np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k) for x, k in zip(table["twice"], size)]).astype(np.int64)
    anchor = np.concatenate(anchor)
    _, at = np.unique(anchor, return_inverse=True)
    n = np.bincount(at, weights=many)
    with np.errstate(over="ignore"):
        _, first, which = np.unique(_mix(anchor * np.uint64(3) + _mix(run)), return_index=True, return_inverse=True)
    times = np.bincount(which, weights=many)
    kinds = np.bincount(at[first], minlength=len(n))[at]
    repeated = times[which] > 1
    code = np.where(n[at] == 1, 0, np.where(kinds == 1, 1, np.where(repeated, 2, 3))).astype(np.uint8)
    stand = first[code[first] == 2]
    code[stand] = 4
    code[(code > 2) & (kinds > most)] += 2
    cuts = np.cumsum([0, *size])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "codes": pa.array([code[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _judge_windows(table: pa.Table) -> pa.Table:
    """Per different window of a block a bit: does it occur twice. Keys hold hashes, and after them which the block holds twice."""
    keys, many = [], []
    for x in table["keys"]:
        data = x.as_py()
        k = int.from_bytes(data[:4], "little")
        keys.append(np.frombuffer(data, "<u8", k, 4))
        many.append(1 + np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + 8 * k), count=k).astype(np.int64))
    size = [len(x) for x in keys]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    twice = np.bincount(at, weights=np.concatenate(many))[at] > 1
    cuts = np.cumsum([0, *size])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "codes": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _judge_strings(table: pa.Table, length: int) -> pa.Table:
    """The same for windows of whole runs: keys hold the runs' sizes and strings.

    Hashes only tell which windows are surely unique. Of the rest, stretches of windows
    that are equal byte for byte are repeated; all different stretches are then sorted by
    their suffixes, which shows what any two of them share.
    """
    strings, runs = [], []
    for x in table["keys"]:
        data = x.as_py()
        k = int.from_bytes(data[:4], "little")
        cuts = np.cumsum([4 + 4 * k, *np.frombuffer(data, "<i4", k, 4)]).tolist()
        strings += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        runs.append(k)
    texts = Texts(strings, length)
    many = texts.size - length + 1
    place = ranges(texts.begin, many)
    _, at, n = np.unique(texts.windows(place), return_inverse=True, return_counts=True)
    maybe = n[at] > 1
    new = np.r_[True, (np.diff(place) != 1) | (np.diff(maybe.astype(np.int8)) != 0)]
    new[starts(many)] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)]
    keep = maybe[first]
    first, last = first[keep], last[keep]
    own: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip(place[first].tolist(), (place[last - 1] + length).tolist())):
        own.setdefault(texts.data[a:b].tobytes(), []).append(i)
    twice = np.zeros(len(place), bool)
    found = repeated_starts(list(own), length) if any(len(v) == 1 for v in own.values()) else [None] * len(own)
    for f, v in zip(found, own.values()):
        for i in v:
            twice[first[i] : last[i]] = True if len(v) > 1 else f[: last[i] - first[i]]
    cuts = np.cumsum([0, *runs])
    ends = np.r_[0, np.cumsum(many)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "codes": pa.array([np.packbits(twice[ends[a] : ends[b]]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _ordered(table: pa.Table) -> pa.Table:
    """A block's documents in an order that depends on their content alone."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _bytes(column: pa.ChunkedArray) -> list[bytes]:
    return [(x.as_py() or "").encode() for x in column]


def _covered(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of `size` bytes lie in [first, last) of some interval."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0


def _finished(ids: pa.Array, texts: Texts, gone: np.ndarray) -> dict[str, pa.Array]:
    sha, removed, spans = [], [], []
    for a, n in zip(texts.begin.tolist(), texts.size.tolist()):
        g = gone[a : a + n]
        removed.append(int(g.sum()))
        spans.append(int((g[1:] & ~g[:-1]).sum() + g[0]) if n else 0)
        own = texts.data[a : a + n]
        sha.append(hashlib.sha256(own[~g] if removed[-1] else own).hexdigest())
    return {"doc_id": ids, "n_bytes": pa.array(texts.size), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}


def _second(length: int, gram: int, buckets: int):
    """Documents and the codes of their runs -> finished documents, windows to ask about, and what is left to finish."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = key[0].as_py()
        docs = _ordered(docs)
        ids = docs["doc_id"].combine_chunks()
        texts = Texts(_bytes(docs["text"]), length, gram)
        first, n, _, anchor, run = texts.runs()
        one, which, _ = _distinct_runs(anchor, run)
        code = np.zeros(len(first), np.uint8)
        if answers.num_rows:
            told = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in answers.sort_by("bucket")["codes"]])
            code = told[which]
            # Only one of equal runs stands for its like; the others are repeated.
            others = np.ones(len(code), bool)
            others[one] = False
            code[others & np.isin(code, (4, 6))] = 2
        sure = np.isin(code, (1, 2, 4, 6))
        # Runs of anchors with few different ones go as strings, by anchor; windows of the others as hashes.
        cold = np.flatnonzero((code == 3) | (code == 4))
        order, cuts = _by_bucket(anchor[cold], buckets)
        cold, hot = cold[order], np.flatnonzero(code >= 5)
        size = n[cold] - 1 + length
        packed = [(b - a).to_bytes(4, "little") + size[a:b].astype("<i4").tobytes() + texts.data[ranges(first[cold[a:b]], size[a:b])].tobytes() for _, a, b in cuts]
        asked = [(buckets + b, int(n[cold[x:y]].sum()), k) for (b, x, y), k in zip(cuts, packed)]
        single = ranges(first[hot], n[hot])
        keys = texts.windows(single)
        by = np.argsort(keys, kind="stable")
        keys, many = np.unique(keys, return_counts=True)
        _, cuts = _by_bucket(keys, buckets)
        asked = [(b, y - x, (y - x).to_bytes(4, "little") + keys[x:y].astype("<u8").tobytes() + np.packbits(many[x:y] > 1).tobytes()) for b, x, y in cuts] + asked
        # Each answer serves so many windows.
        many = np.concatenate([many, np.ones(int(n[cold].sum()), np.int64)])
        # In the order in which buckets answer.
        window = np.concatenate([single[by], ranges(first[cold], n[cold])])
        stands = np.concatenate([np.repeat(code[hot] == 6, n[hot])[by], np.repeat(code[cold] == 4, n[cold])])
        open_ = window[~stands]
        doc = np.searchsorted(texts.begin + texts.size, open_, side="right")
        left = np.zeros(len(ids), bool)
        left[doc] = True
        gone = _covered(len(texts.data), first[sure], first[sure] + n[sure] - 1 + length)
        sizes, begins = texts.size, texts.begin
        done = np.flatnonzero(~left)
        rows = []
        if len(done):
            part = Texts([texts.data[begins[i] : begins[i] + sizes[i]].tobytes() for i in done.tolist()], length, gram)
            kept = _finished(ids.take(pa.array(done)), part, gone[ranges(begins[done], sizes[done])])
            k = len(done)
            rows.append(pa.table({"block": pa.array(np.full(k, block), pa.int64()), "kind": pa.array(np.zeros(k), pa.int32()), **kept}))
        if asked:
            k = len(asked)
            rows.append(pa.table({"block": pa.array([block] * k, pa.int64()), "kind": pa.array([1] * k, pa.int32()), "n_bytes": pa.array([x[1] for x in asked], pa.int64()), "bucket": pa.array([x[0] for x in asked], pa.int32()), "keys": pa.array([x[2] for x in asked], pa.binary())}))
        some = np.flatnonzero(left)
        if len(some):
            byte = ranges(begins[some], sizes[some])
            # Windows to be asked about, by their place in the documents that are left (-1: stands for others only).
            moved = np.full(len(window), -1, np.int64)
            at = np.searchsorted(begins + sizes, window, side="right")
            new = np.zeros(len(ids), np.int64)
            new[some] = starts(sizes[some])
            mine = left[at] & ~stands
            moved[mine] = (window - begins[at] + new[at])[mine]
            zip_ = zstandard.ZstdCompressor(level=3).compress
            rest = {"text": zip_(texts.data[byte].tobytes()), "gone": zip_(np.packbits(gone[byte]).tobytes()), "asked": zip_(moved.astype("<i4").tobytes()), "many": zip_(many.astype("<i4").tobytes())}
            ids_left = ids.take(pa.array(some))
            rows.append(pa.table({"block": pa.array([block], pa.int64()), "kind": pa.array([2], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids_left)], pa.int32()), ids_left), "sizes": pa.array([sizes[some].astype("<i8").tobytes()], pa.binary()), **{c: pa.array([v], pa.binary()) for c, v in rest.items()}}))
        schema = _second_schema(ids.type)
        return pa.concat_tables([pa.table({f.name: (t[f.name] if f.name in t.column_names else pa.nulls(t.num_rows, f.type)) for f in schema}, schema=schema) for t in rows]) if rows else schema.empty_table()

    return run


def _second_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", kind), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.list_(kind)), ("sizes", pa.binary()), ("text", pa.binary()), ("gone", pa.binary()), ("asked", pa.binary()), ("many", pa.binary())])


def _third(length: int, gram: int):
    """What was left to finish, and whether its windows are repeated -> finished documents."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8)) for x in answers.sort_by("bucket")["codes"]]
        for r in range(left.num_rows):
            row = {c: left[c][r].as_py() for c in ("sizes", "text", "gone", "asked", "many")}
            un = zstandard.ZstdDecompressor().decompress
            sizes = np.frombuffer(row["sizes"], "<i8")
            data = un(row["text"])
            gone = np.unpackbits(np.frombuffer(un(row["gone"]), np.uint8), count=len(data)).astype(bool)
            asked = np.frombuffer(un(row["asked"]), "<i4").astype(np.int64)
            # Each bucket's bits are padded to a byte; its own number of keys is known from the next table.
            count = np.array([x.as_py() for x in answers.sort_by("bucket")["n"]], np.int64)
            twice = np.concatenate([b[:n] for b, n in zip(bits, count)]).astype(bool) if len(bits) else np.zeros(0, bool)
            twice = np.repeat(twice, np.frombuffer(un(row["many"]), "<i4"))
            hit = asked[twice & (asked >= 0)]
            gone |= _covered(len(data), hit, hit + length)
            cuts = np.cumsum(np.r_[0, sizes])
            texts = Texts([data[a:b] for a, b in zip(cuts, cuts[1:])], length, gram)
            out.append(pa.table(_finished(left["ids"][r].values, texts, gone)))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        kind = left.schema.field("ids").type.value_type
        return pa.concat_tables(out) if out else pa.schema([("doc_id", kind), *((c, pa.int64()) for c in names[1:4]), (names[4], pa.string())]).empty_table()

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_chars: int = BLOCK_CHARS, bucket_keys: int = BUCKET_KEYS, most_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    Each byte is removed that a string of `length` bytes covers which also starts
    elsewhere, in the same text or another; strings do not cross texts, and are judged on
    the input. Spans are maximal runs of removed bytes. A null text is empty; texts
    shorter than `length` stay whole; a repeated row is a text elsewhere. Texts of any
    length are worked on in bounded pieces. Other columns are not read. Hashes have 64 bits.

    most_runs: windows at which runs differ are found by suffix sorting of the runs'
    strings (see suffix_groups.py), the runs of one anchor together. Beyond so many
    different runs of one anchor, as around a passage that very many texts share, each of
    their windows is counted for itself, which any number of tasks can share.
    """
    if not 0 < gram < length:
        raise ValueError("an anchor is shorter than a window")
    kind = dict(docs.dtypes)["doc_id"]
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    buckets = max(1, -(-2 * chars // ((length - gram + 2) * bucket_keys)))
    strings = 32 * buckets  # strings are sorted in Python, so a task has few of them
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition(blocks, "block")

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, _, anchor, run = Texts(_bytes(_ordered(table)["text"]), length, gram).runs()
        one, _, twice = _distinct_runs(anchor, run)
        anchor, run = anchor[one], run[one]
        _, cuts = _by_bucket(anchor, buckets)
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
            "keys": pa.array([_five(anchor[a:b]) for _, a, b in cuts], pa.binary()), "runs": pa.array([run[a:b].astype("<u8").tobytes() for _, a, b in cuts], pa.binary()),
            "twice": pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in cuts], pa.binary()),
        })

    def judge_runs(table: pa.Table) -> pa.Table:
        return _judge_runs(table, most_runs)

    def judge(table: pa.Table) -> pa.Table:
        return _judge_strings(table, length) if table["bucket"][0].as_py() >= strings else _judge_windows(table)

    asked = placed.groupBy("block").applyInArrow(first, "block long, bucket int, keys binary, runs binary, twice binary")
    codes = asked.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(judge_runs, "block long, bucket int, codes binary").repartition(blocks, "block")
    second = placed.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(
        _second(length, gram, strings), f"block long, kind int, doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, bucket int, keys binary, ids array<{kind}>, sizes binary, text binary, gone binary, asked binary, many binary"
    )
    second = materialize(second, "repeats")
    windows = second.where("kind = 1")
    # Few bytes, but much work: as many tasks as said here, which bytes would not ask for.
    judged = windows.select("block", "bucket", "keys").repartition(8 * buckets, "bucket").groupBy("bucket").applyInArrow(judge, "block long, bucket int, codes binary")
    sized = windows.select("block", "bucket", F.col("n_bytes").alias("n"))
    told = judged.join(sized, ["block", "bucket"])
    left = second.where("kind = 2").select("block", "ids", "sizes", "text", "gone", "asked", "many")
    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    last = left.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_third(length, gram), result)
    return second.where("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(last)
