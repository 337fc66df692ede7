"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are compared exactly, never sampled. Two 64-bit fingerprints within
radius 3 agree in at least one of four 16-bit blocks, so each distinct fingerprint
meets only those that share a block with it (at most 4 * 65,536 buckets). In a
bucket, rows sorted by population count form tiles; a pair of tiles is compared by
numpy exclusive-or and bit counts, and skipped when the population counts of the two
differ by more than the radius. A bucket of more than BUCKET rows is dealt over
several tasks by bands of population counts, of which only neighbouring bands meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import joined, materialize, may_be_in, ranges, split_words, spread_join, starts, text_slices, xxh64_spans
from graphloom.llm.components import components, members

BLOCKS, BLOCK_BITS, TILE, BUCKET = 4, 16, 256, 8192
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of all texts in a row, repeats included, and how many each text has."""
    words, n = split_words(pc.ascii_lower(pc.fill_null(text, "")))
    data, at, size = joined(words)
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    first = ranges(starts(n), count)
    last = first + np.repeat(np.minimum(n, shingle) - 1, count)
    return xxh64_spans(data, at[first], at[last] + size[last] - at[first]), count


def majority_bits(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The SimHash of each run of hashes, as uint64 (none: zero)."""
    out = np.zeros(len(count), np.uint64)
    has = np.nonzero(count)[0]
    if not len(has):
        return out
    # Bit counts add up in the bytes of eight words, 255 shingles at a time at most.
    pieces = -(-count[has] // 255)
    piece_first = ranges(np.zeros(len(has), np.int64), pieces) * 255 + np.repeat(starts(count[has]), pieces)
    sums = np.zeros((len(has), 64), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _BYTES, piece_first).view(np.uint8).reshape(-1, 8)
        sums[:, j::8] = np.add.reduceat(lanes.astype(np.int64), starts(pieces), axis=0)
    bits = (2 * sums > count[has, None]).astype(np.uint8)
    out[has] = np.packbits(bits, axis=1, bitorder="little").reshape(-1, 8).view("<u8").ravel()
    return out


def fingerprints_of(text: pa.Array, shingle: int = 3) -> np.ndarray:
    """The SimHash of each text, as uint64 (no word: zero)."""
    return majority_bits(*shingle_hashes(text, shingle))


def fingerprint_rows(docs: DataFrame, shingle: int = 3, *keep: str) -> DataFrame:
    """doc_id, the columns in `keep` (longs) and fp (long), in the order and number of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                fp = fingerprints_of(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *keep)), pa.array(fp)], ["doc_id", *keep, "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", *keep, "text").mapInArrow(run, f"doc_id {kind}, {''.join(c + ' long, ' for c in keep)}fp long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each edge one label, the least of both, until no edge differs."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose fingerprints differ in `radius` bits at most, for each pair of tiles.

    Rows are sorted by group (numbers) and, within one, by population count. Tiles run over
    group borders, so many small groups share one. Tiles that have no group in common are
    not compared, nor those of one group whose population counts differ by more than the radius.
    """
    pop = np.bitwise_count(fp).astype(np.int64)
    for i in range(0, len(fp), TILE):
        end = min(i + TILE, len(fp)) - 1
        for j in range(i, len(fp), TILE):
            if j > i and (group[j] != group[end] or pop[j] - pop[end] > radius):
                break
            close = np.bitwise_count(fp[i : i + TILE, None] ^ fp[None, j : j + TILE]) <= radius
            close &= group[i : i + TILE, None] == group[None, j : j + TILE]
            if i == j:
                close = np.triu(close, 1)
            a, b = np.nonzero(close)
            yield a + i, b + j


def linked(fp: np.ndarray, radius: int = 3, group: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """For each of these fingerprints the place of its component's, by links within its group.

    side: a pair of one group links only if it is on different sides, or on side -1.
    """
    group = np.zeros(len(fp), np.int64) if group is None else group
    order = np.lexsort((np.bitwise_count(fp), group))
    f, g = fp[order], group[order]
    sides = side[order] if side is not None else None
    label = np.arange(len(f))
    for a, b in close_pairs(f, g, radius):
        if sides is not None:
            keep = (sides[a] != sides[b]) | (sides[a] < 0)
            a, b = a[keep], b[keep]
        _merge(label, a, b)
    out = np.empty(len(f), np.int64)
    out[order] = order[label]
    return out


def dealt(keyed: DataFrame, radius: int, bucket: int = BUCKET, bounded: bool = False) -> DataFrame:
    """keyed (fp, key and others) with x, y, tile, so that rows of one (key, x, y) meet; sorted by these.

    A key of more than `bucket` rows is parted into tiles: bands of population counts, each
    of several parts. A row then stands once for each tile of its band and the bands beside
    it: rows of (x, y) are those of two tiles, and only pairs across them are new, or, where
    x is y, all. Other keys are one tile, -1. bounded: so few keys exist that the large ones
    may be sent to all tasks; else the planner sees their number.
    """
    counted = keyed.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("parts"))
    large = F.broadcast(counted) if bounded else materialize(counted, "large_keys")
    band = (F.bit_count("fp") / (radius + 1)).cast("int")
    tile = band * F.col("parts") + F.pmod(F.hash(*[c for c in keyed.columns if c != "key"]), F.col("parts"))
    # A row of a large key meets the parts of its own band and of the bands beside it.
    others = F.flatten(F.transform(F.array(band - 1, band, band + 1), lambda x: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda y: x * F.col("parts") + y)))
    met = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(others)
    own = keyed.columns
    out = keyed.join(large, "key", "left").select(*own, F.when(F.col("parts").isNotNull(), tile).otherwise(-1).alias("tile"), F.explode(met).alias("other"))
    out = out.select(*own, F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile")
    return out.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of complete groups (key, x, y) of dealt rows, with the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def done() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        key, x, y = (rows[c].to_numpy() for c in ("key", "x", "y"))
        return rows, np.cumsum(np.r_[0, (np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, x, y = (batch.column(c).to_numpy() for c in ("key", "x", "y"))
        cut = int(np.argmax((k == k[-1]) & (x == x[-1]) & (y == y[-1])))  # before it every group is complete
        if cut or (held and last != (k[0], x[0], y[0])):
            held.append(batch.slice(0, cut))
            yield done()
            held.clear()
        held.append(batch.slice(cut))
        last = (k[-1], x[-1], y[-1])
    if held:
        yield done()


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b between the distinct longs of fps.fp that keep each group within `radius` connected."""
    if radius >= BLOCKS:
        raise ValueError("four blocks find pairs of three differing bits at most")
    blocks = F.array(*(F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) + F.lit(i << BLOCK_BITS) for i in range(BLOCKS)))
    keyed = fps.select("fp", F.explode(F.transform(blocks, lambda x: x.cast("int"))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches):
            fp = rows["fp"].to_numpy().view(np.uint64)
            x, y, tile = (rows[c].to_numpy() for c in ("x", "y", "tile"))
            root = linked(fp, radius, group, np.where(x == y, -1, tile))
            moved = np.nonzero(root != np.arange(len(fp)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (fp[moved], fp[root[moved]])], ["a", "b"])

    # At most BLOCKS * 2**BLOCK_BITS keys exist, whatever the input.
    return dealt(keyed, radius, bucket, bounded=True).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Fingerprints of at most `radius` differing bits link; component_id is the least
    doc_id that links reach. Null or blank texts have fingerprint zero and link like any
    other. Rows of one doc_id stay apart; a null doc_id never names a component unless no
    other id is in it. Other columns are not read. Empty input gives empty output.
    """
    rows = materialize(fingerprint_rows(docs, shingle), "simhash")
    prints = fingerprint_components(rows, radius)
    return spread_join(rows, prints, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_components(rows: DataFrame, radius: int, least: str = "doc_id") -> DataFrame:
    """fp, n (rows), component_id (the least of a column that links reach) of each distinct fingerprint of rows."""
    one = materialize(rows.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")), "fingerprints")
    root = materialize(members(components(links(one.select("fp"), radius)), "fp"), "roots")
    placed = one.join(root, "fp")
    by_root = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    linked_ = spread_join(placed, by_root, "root", "__n").select("fp", "n", "component_id")
    return materialize(linked_.unionByName(one.join(root, "fp", "left_anti").select("fp", "n", F.col("least").alias("component_id"))), "components")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs without all but one row of each group: that of the least doc_id, and of its rows the one of the least text hash.

    Rows, not ids, are kept or dropped: where one doc_id has several texts, each stays or
    goes with its own group. Of rows alike in doc_id and text any one stays. All
    columns stay as they are; rows without a doc_id stay. Null texts are empty; an empty
    table stays empty.
    """
    own = docs.where(F.col("doc_id").isNotNull())
    rows = materialize(fingerprint_rows(own.withColumn("h", text_hash()), shingle, "h"), "simhash")
    prints = fingerprint_components(rows.withColumn("row", F.struct("doc_id", "h")), radius, "row")
    return first_only(docs, spread_join(rows, prints.withColumnRenamed("component_id", "least"), "fp"))


def text_hash(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def first_only(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, text hash) is not the `least` of placed (doc_id, h, least), and one each of the rest.

    What goes is looked for, not what stays: it is the lesser part. Rows that a map of fixed
    size shows to stay are not moved; only the others meet the keys. Rows without a doc_id stay.
    """
    stays = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    counted = placed.groupBy("doc_id", "h").agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    marked = materialize(counted.where("not stays or n > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "stays"), "marked")
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__h": text_hash(), "__key": F.xxhash64("doc_id", text_hash())})
    keyed = may_be_in(keyed, "__key", marked.select(F.xxhash64("__id", "__h")))
    some = keyed.where("__maybe")
    once = some.join(marked, ["__id", "__h"], "left_anti")
    repeated = some.join(marked.where("stays").drop("stays"), ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
    return keyed.where("not __maybe").select(*docs.columns).unionByName(once.unionByName(repeated).select(*docs.columns))
