"""Secret scans with corpus-wide ownership frequency.

Three kinds of pattern give candidates. Over the corpus each candidate value's hash is
counted by distinct owners and repositories: a value that many owners hold, or two owners
in several repositories, is a copied example; one that few hold is a live-looking
credential. Values that a pattern names somewhere are also looked for where they stand
alone, without a keyword ("known" spans): a bitmap of fixed size, of all such values, says
which words could be one, and a join of hashes which are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, spread_join, text_slices
from graphloom.llm.simhash import text_hash

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BARE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
KINDS = ("assign", "access", "hex", "known")
#: A value of so many owners, or of two owners and so many repositories, is an example that is widely copied.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 4
#: Bits of the map of values that patterns name: one megabyte, however many there are.
MAP_BITS = 23

Span = tuple[int, int, int, int, str]


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode()) - (1 << 63)


def _slot(value: str) -> int:
    return zlib.crc32(value.encode()) & ((1 << MAP_BITS) - 1)


def base_spans(text: str) -> list[Span]:
    """start, kind, end, start of the value, value of each candidate, by start and kind; code points, end exclusive.

    The dots that close a value, as at the end of a sentence, are in the span, but not in the value.
    """
    out = [(m.start(), 0, m.end(), m.start(1), m[1].rstrip(".")) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def bare_spans(text: str, base: list[Span], may_be) -> list[Span]:
    """Words of eight characters or more that touch no candidate and may be a named value; the same of their value."""
    some = {w for w in set(BARE.findall(text)) if may_be(w.rstrip("."))}
    out, at, reach = [], 0, -1
    for m in BARE.finditer(text) if some else ():
        if m[0] in some:
            while at < len(base) and base[at][0] < m.end():
                reach = max(reach, base[at][2])
                at += 1
            if reach <= m.start():
                v = m[0].rstrip(".")
                out.append((m.start(), 3, m.start() + len(v), m.start(), v))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = "array<struct<at:int,kind:int,end:int,hash:long,slot:int>>"
_KIND = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("slot", pa.int32())]))


def _spans(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"at": s, "kind": k, "end": e, "hash": _hash(v), "slot": _slot(v)} for s, k, e, _, v in r] for r in rows], _KIND)


def _owned(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    return docs.select("doc_id", text_hash().alias("h"), F.col(owner).cast("string").alias("__owner"), F.concat_ws("/", F.col(owner).cast("string"), F.col(repository).cast("string")).alias("__repository"), F.col("text").alias("__text"))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """Per row of docs: __uid, doc_id, h (hash of the text), __owner, __repository, __found; materialised, so __uid holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, "__text"):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), *part.columns[:-1], _spans([base_spans(t.as_py() or "") for t in part.column("__text")])], ["__uid", *part.schema.names[:-1], "__found"])
                uid += n

    kind = dict(docs.dtypes)["doc_id"]
    return materialize(_owned(docs, owner, repository).mapInArrow(run, f"__uid long, doc_id {kind}, h long, __owner string, __repository string, __found {_FOUND}"), "candidates")


def named_map(found: DataFrame) -> np.ndarray:
    """The bitmap of the values that patterns name, as bytes: at most 2**MAP_BITS / 64 rows reach the driver."""
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    slot = found.select(F.explode("__found.slot").alias("slot"))
    for r in slot.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits")).toLocalIterator():
        out[r.word] = r.bits
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"), bitorder="little")


def bare_candidates(docs: DataFrame, found: DataFrame, owner: str, repository: str) -> DataFrame:
    """h, __owner, __repository, __found of the rows of docs in which a word may be a value that a pattern names somewhere; materialised."""
    own = _owned(docs, owner, repository).drop("doc_id")
    known = named_map(found)
    sent = docs.sparkSession.sparkContext.broadcast(known.tobytes()) if known.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value

        def may_be(word: str) -> bool:
            at = _slot(word)
            return bool(bits[at >> 3] >> (at & 7) & 1)

        for batch in batches:
            for part in text_slices(batch, "__text"):
                rows = []
                for t in part.column("__text"):
                    text = t.as_py() or ""
                    some = bare_spans(text, [], may_be)
                    rows.append(bare_spans(text, base_spans(text), may_be) if some else some)
                keep = [bool(r) for r in rows]
                yield pa.RecordBatch.from_arrays([*part.filter(pa.array(keep, pa.bool_())).columns[:-1], _spans([r for r in rows if r])], [*part.schema.names[:-1], "__found"])

    schema = f"h long, __owner string, __repository string, __found {_FOUND}"
    return materialize(own.mapInArrow(run, schema) if sent else docs.sparkSession.createDataFrame([], schema), "bare")


def ownership(*found: DataFrame) -> DataFrame:
    """hash, owners, repositories, holders (spans), named (stands in a pattern somewhere) of each candidate value.

    Summed by (hash, owner, repository) first, so a value in a third of all rows is few
    rows by the time that it meets its hash. A null owner is one owner of its own.
    """
    each = None
    for f in found:
        own = f.select("__owner", "__repository", F.explode("__found").alias("f")).select("__owner", "__repository", F.col("f.hash").alias("hash"), (F.col("f.kind") < 3).alias("named"))
        each = own if each is None else each.unionByName(own)
    small = each.groupBy("hash", "__owner", "__repository").agg(F.count("*").alias("holders"), F.max("named").alias("named"))
    by_owner = small.groupBy("hash", "__owner").agg(F.count("*").alias("repositories"), F.sum("holders").alias("holders"), F.max("named").alias("named"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("holders").alias("holders"), F.max("named").alias("named"))


def is_live(owners: int, repositories: int) -> Column:
    """Whether the columns owners and repositories are those of a value that is not widely copied."""
    return ~((F.col("owners") >= owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= repositories)))


def judged(docs: DataFrame, owner: str, repository: str, example_owners: int, example_repositories: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidates; bare_candidates; and hash, live, holders of each value that a pattern names, materialised."""
    found = candidates(docs, owner, repository)
    bare = bare_candidates(docs, found, owner, repository)
    owners = ownership(found, bare).where("named").select("hash", is_live(example_owners, example_repositories).alias("live"), "holders")
    return found, bare, materialize(owners, "ownership")


def _known(bare: DataFrame, owners: DataFrame) -> DataFrame:
    """h, __known (at, end of its live bare values), n (rows) of each text that has some."""
    texts = bare.groupBy("h").agg(F.first("__found").alias("__found"), F.count("*").alias("n"))
    each = texts.select("h", "n", F.explode("__found").alias("f")).select("h", "n", F.struct("f.at", "f.end").alias("span"), F.col("f.hash").alias("hash"))
    return spread_join(each, owners.where("live"), "hash", "holders").groupBy("h").agg(F.sort_array(F.collect_list("span")).alias("__known"), F.first("n").alias("n"))


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "lang", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_known, n_live, n_example of every row of docs.

    spans: the patterns' matches and, added, "known" ones: bare words of eight characters
    or more (closing dots left out) that are a value which a pattern finds elsewhere and
    that is live. n_live and n_example sort the patterns' values by ownership. A null text
    is empty. Repeated rows are scanned each, and one owner's repeats count as one; null
    owners are one owner. Other columns are not read; an empty table gives an empty result.
    """
    found, bare, owners = judged(docs, owner, repository, example_owners, example_repositories)
    each = found.where(F.size("__found") > 0).select("__uid", F.explode("__found").alias("f")).select("__uid", "f.at", "f.kind", "f.end", F.col("f.hash").alias("hash"))
    spans = spread_join(each, owners, "hash", "holders").groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "end", "live"))).alias("__spans"))
    known = materialize(_known(bare, owners), "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for spans, bare in zip(batch.column("__spans").to_pylist(), batch.column("__known").to_pylist()):
                spans = spans or []
                base = [(x["at"], x["kind"], x["end"]) for x in spans]
                more = [(x["at"], 3, x["end"]) for x in bare or ()]
                live = sum(x["live"] for x in spans)
                row = [*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more), live, len(base) - live]
                for c, v in zip(columns, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(columns))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_known", "n_live", "n_example"])

    # Rows without a candidate, nearly all, meet nothing but the few texts that have bare values.
    blank = F.lit(None).cast("array<struct<at:int,kind:int,end:int,live:boolean>>")
    rows = found.where(F.size("__found") > 0).select("__uid", "doc_id", "h").join(spans, "__uid", "left").select("doc_id", "h", "__spans")
    rows = rows.unionByName(found.where(F.size("__found") == 0).select("doc_id", "h", blank.alias("__spans")))
    none = rows.join(known.select("h"), "h", "left_anti").withColumn("__known", F.lit(None).cast("array<struct<at:int,end:int>>"))
    every = none.unionByName(spread_join(rows, known, "h").drop("n"))
    kind = dict(docs.dtypes)["doc_id"]
    return every.select("doc_id", "__spans", "__known").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_known long, n_live long, n_example long")


def redact_live(docs: DataFrame, owner: str = "source", repository: str = "lang", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, mask: str = "[secret]") -> DataFrame:
    """docs with live-looking values masked in their text; copied examples stay, and so does every row.

    Where the columns of documents are there, n_chars is the new text's length. Texts in
    which nothing is masked, null and empty ones among them, are left as they are, and so
    is their n_chars. Rows go by their text: a null doc_id is no matter, and equal texts
    are masked alike, in each of their rows. An empty table stays empty.
    """
    found, bare, owners = judged(docs, owner, repository, example_owners, example_repositories)
    live = owners.where("live")
    values = None
    for f in (found, bare):
        texts = f.where(F.size("__found") > 0).groupBy("h").agg(F.first("__found.hash").alias("hashes"))
        own = spread_join(texts.select("h", F.explode(F.array_distinct("hashes")).alias("hash")), live, "hash", "holders").select("h", "hash")
        values = own if values is None else values.unionByName(own)
    per_text = materialize(values.groupBy(F.col("h").alias("__h")).agg(F.collect_set("hash").alias("__live")), "live_texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = []
                for t, own in zip(part.column("text"), part.column("__live")):
                    text, hashes = t.as_py(), set(own.as_py())
                    base = base_spans(text)
                    out, at = [], 0
                    for _, _, e, first, v in sorted([*base, *bare_spans(text, base, lambda w: _hash(w) in hashes)]):
                        first, e = max(at, first), max(e, first + len(v))
                        if _hash(v) in hashes and e > first:
                            out += [text[at:first], mask]
                            at = e
                    texts.append("".join(out) + text[at:])
                new = dict(zip(part.schema.names, part.columns))
                new["text"] = pa.array(texts, part.schema.field("text").type)
                if "n_chars" in new:
                    new["n_chars"] = pa.array([len(t) for t in texts]).cast(new["n_chars"].type)
                del new["__live"]
                yield pa.RecordBatch.from_arrays(list(new.values()), list(new))

    # Texts that hold no live value, nearly all, stay where they are.
    keyed = docs.withColumn("__h", text_hash())
    masked = keyed.join(per_text, "__h").drop("__h").mapInArrow(run, docs.schema)
    return keyed.join(per_text.select("__h"), "__h", "left_anti").drop("__h").unionByName(masked)
