"""Near-duplicates by SimHash tiles inside buckets of rare shingles, confirmed by Jaccard's index.

Texts whose sets of five-word shingles have an index of 0.8 or more differ in far more than
three bits of a SimHash, so no blocks of bits find them. Their buckets are shingles instead:
two such sets share one of the first n - ceil(0.8 n) + 1 shingles of each, whatever order all
shingles are put in. The order here is rare ones first; those that a sample of texts repeats
come last, so the sample only moves work, never pairs.

1. Each task packs the keys of its texts with the digests of their sets, by ranges of the
   key; a range's task says which keys two different sets hold. Only these become rows.
2. In each key's rows all meet the set of which the greatest part is shared: the one that the
   others were copied from, as copies have edits of their own. This makes one component of
   nearly every large group.
3. Keys that still hold several components go through the tiles of simhash.py: exclusive-or
   and bit counts of fingerprints, tile pairs skipped by population counts, large keys dealt
   over tasks. RADIUS is fourteen bits beyond the ten that an index of 0.8 is expected to
   give, five deviations; sets under EXACT_BELOW shingles all meet in their key.
   Two sets a, b (the smaller first) that are alike share 4 (a + b) / 9 - 4 b / 5 keys or
   more of their prefixes. So the first of the keys that they share is among the first of
   each one's keys, all but so many. Sets of nearly one size, as the copies of one text
   are, thus meet in few keys, and those that could not be alike in none.
4. Each pair that meets is confirmed on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, may_be_in, ranges, spread_join, starts, text_slices
from graphloom.llm.components import components, members
from graphloom.llm.simhash import close_pairs, dealt, first_only, majority_bits, shingle_hashes, text_hash, whole_groups

SHINGLE, LIKENESS, RADIUS, EXACT_BELOW = 5, (4, 5), 24, 40
#: Bounds of the classes of pairs by the ratio of their sizes, in hundredths.
RATIOS = (100, 97, 90, 80)
#: Texts that the order of shingles is taken from, about, and how many shingles it puts last at most.
SAMPLE_ROWS, MOST_COMMON = 20_000, 100_000
#: Keys that a task packs at a time, and that a range of keys holds, about.
PIECE_KEYS, RANGE_KEYS = 1_000_000, 400_000
#: A shingle of so many of the sampled texts is known to be shared; it needs no range to say so.
HOT_TEXTS = 20
_KEY = np.uint64((1 << 48) - 1)


def distinct_in(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each run, ascending, and how many it has."""
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(count)).astype(np.int64)


def shingle_sets(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, ascending within each, and how many each text has."""
    return distinct_in(*shingle_hashes(text, shingle))


def _six(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = starts(n).tolist()
    return np.array([xxhash.xxh64_intdigest(h[a : a + k].tobytes()) for a, k in zip(at, n.tolist())], np.uint64)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a sample of docs has in four texts or more, ascending, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part.column("text"))[0].view(np.int64))], ["h"])

    share = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text").mapInArrow(run, "h long")
    top = sample.groupBy("h").count().where("count >= 4").orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, seen = top["h"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(h)
    return h[order], seen[order]


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), digest of the set, n (its size) and fp (its SimHash) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h, n = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(_digests(h, n).view(np.int64)), pa.array(n), pa.array(majority_bits(h, n).view(np.int64))], ["doc_id", "h", "digest", "n", "fp"])

    return docs.select("doc_id", "text", text_hash().alias("h")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, digest long, n long, fp long")


def prefixes(text: pa.Array, known: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key (48 bits of a shingle), digest and rank of each prefix entry of different sets among the texts."""
    h, n = shingle_sets(text)
    digest = _digests(h, n)
    _, first = np.unique(digest, return_index=True)
    one = np.zeros(len(n), bool)
    one[first] = True
    h, n, digest = h[np.repeat(one, n)], n[one], digest[one]
    rank = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, seen[at], 0)
    order = np.lexsort((h, rank, np.repeat(np.arange(len(n)), n)))
    length = np.where(n > 0, n - -(-LIKENESS[0] * n // LIKENESS[1]) + 1, 0)
    own = order[ranges(starts(n), length)]
    return h[own] & _KEY, np.repeat(digest, length), rank[own]


def packed_keys(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], parts: int, piece_keys: int = PIECE_KEYS) -> DataFrame:
    """part, keys, digests: the prefixes of docs by ranges of the key; parts below 0 hold keys known to be shared."""
    known, seen = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            key, digest, rank = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = ((key >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            hot = rank >= HOT_TEXTS
            # The negative parts only spread: by the digest, as a hot key may be in any number of texts.
            part[hot] = -1 - (digest[hot] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((digest, key, part))
            key, digest, part = key[order], digest[order], part[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
            key, digest, part = key[new], digest[new], part[new]
            which, first = np.unique(part, return_index=True)
            cuts = [*first.tolist(), len(part)]
            return pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int64()), pa.array([_six(key[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([digest[a:b].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                ["part", "keys", "digests"],
            )

        size = 0
        for batch in batches:
            for some in text_slices(batch):
                held.append(prefixes(some.column("text"), known, seen))
                size += len(held[-1][0])
                if size >= piece_keys:
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "part long, keys binary, digests binary")


def shared_keys(packed: DataFrame, parts: int) -> DataFrame:
    """key, digest of the keys that two different digests hold."""

    def run(table: pa.Table) -> pa.Table:
        key = _from_six(b"".join(x.as_py() for x in table["keys"]))
        digest = np.frombuffer(b"".join(x.as_py() for x in table["digests"]), "<u8")
        order = np.lexsort((digest, key))
        key, digest = key[order], digest[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        key, digest = key[new], digest[new]
        if table["part"][0].as_py() >= 0:
            same = key[1:] == key[:-1]
            keep = np.r_[same, False] | np.r_[False, same] if len(key) else np.zeros(0, bool)
            key, digest = key[keep], digest[keep]
        return pa.table({"key": pa.array(key.view(np.int64)), "digest": pa.array(digest.view(np.int64))})

    return packed.repartition(2 * parts, "part").groupBy("part").applyInArrow(run, "key long, digest long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, hashes (48 bits each, packed, in no order) of the digests in wanted (h, digest).

    Texts that a map of fixed size shows not to be wanted are not moved nor read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h, n = shingle_sets(part.column("text"))
                data, at = _six(h), (6 * starts(n)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(_digests(h, n).view(np.int64)), pa.array([data[a : a + 6 * k] for a, k in zip(at, n.tolist())], pa.binary())], ["digest", "hashes"])

    some = may_be_in(docs.select("text", text_hash().alias("h")), "h", wanted.select("h")).where("__maybe").select("text")
    return some.mapInArrow(run, "digest long, hashes binary").join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def possible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many keys as those of alike sets do; lists: digest, n, keys."""
    a, b = (lists.select(F.col("digest").alias(s), F.col("n").alias(f"n_{s}"), F.col("keys.key").alias(f"keys_{s}")) for s in "ab")
    four, five = LIKENESS
    overlap = F.expr(f"({four} * (n_a + n_b) + {four + five - 1}) div {four + five}")
    rest = F.expr(f"({four} * greatest(n_a, n_b) + {five - 1}) div {five} - 1")
    return pairs.join(a, "a").join(b, "b").where(F.size(F.array_intersect("keys_a", "keys_b")) >= overlap - rest).select("a", "b")


def confirmed(docs: DataFrame, pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests whose sets are alike enough; lists: the hash of a text of each digest, n and keys.

    Sets are made anew, of the texts in some pair only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = _from_six(x.as_buffer()), _from_six(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(LIKENESS[1] * both >= LIKENESS[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(possible(pairs, lists), "near_pairs")
    wanted = materialize(lists.join(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "digest", "left_semi").select("h", "digest"), "wanted")
    sets = materialize(sets_of(docs, wanted), "shingle_sets")
    x = sets.select(F.col("digest").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("digest").alias("b"), F.col("hashes").alias("y"))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near_links")


def _near_size(a: Column, b: Column) -> Column:
    return LIKENESS[1] * F.least(a, b) >= LIKENESS[0] * F.greatest(a, b)


def _may_be_near(a: Column, b: Column) -> Column:
    """Of structs with n and fp: sizes that allow the likeness, and fingerprints that make it likely."""
    return _near_size(a["n"], b["n"]) & ((F.least(a["n"], b["n"]) < EXACT_BELOW) | (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= RADIUS))


def pairs_in_tiles(rows: DataFrame) -> DataFrame:
    """Pairs a, b of digests that share a key of rows (key, digest, n, fp, root, place, many) and have different roots, by tiles.

    place: where the key is among the digest's `many` keys, in an order that all digests share.
    """
    short_too = F.col("n") * LIKENESS[0] < EXACT_BELOW * LIKENESS[1]  # a short set can be like one that is a quarter larger at most
    entries = []
    for c, low in enumerate(RATIOS[1:]):
        least = F.greatest(F.lit(1), F.floor(F.col("n") * (20 * low - 1600) / 4500))
        meets = F.col("place") <= F.col("many") - least + 1
        entries.append(F.when(meets & (F.col("n") >= EXACT_BELOW), F.struct((F.col("key") * 8 + 2 * c).alias("key"), F.col("fp").alias("fp"))))
        # These meet whatever their bits.
        entries.append(F.when(meets & short_too, F.struct((F.col("key") * 8 + 2 * c + 1).alias("key"), F.lit(0).cast("long").alias("fp"))))
    keyed = rows.select("digest", "n", "root", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("digest", "n", "root", F.col("e.key").alias("key"), F.col("e.fp").alias("fp"))
    high, low = np.array(RATIOS[:-1]), np.array(RATIOS[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches):
            fp = table["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((np.bitwise_count(fp), group))
            digest, n, root, key, x, y, tile = (table[c].to_numpy()[order] for c in ("digest", "n", "root", "key", "x", "y", "tile"))
            size = (key & 7) >> 1
            for a, b in close_pairs(fp[order], group[order], RADIUS):
                less, more = 100 * np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                keep = (root[a] != root[b]) & ((x[a] == y[a]) | (tile[a] != tile[b])) & (less >= low[size[a]] * more) & ((less < high[size[a]] * more) | (size[a] == 0))
                a, b = digest[a[keep]], digest[b[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt(keyed, RADIUS).mapInArrow(run, "a long, b long").distinct()


def likeness_roots(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, root: the digests of rows (h, digest, n, fp) that links of alike sets join."""
    parts = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // (LIKENESS[1] * RANGE_KEYS)))
    keys = materialize(shared_keys(packed_keys(docs, common_shingles(docs), parts), parts), "shared_keys")
    one = rows.groupBy("digest").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    one = materialize(one.join(keys.groupBy("digest").agg(F.count("*").alias("many")), "digest"), "sharing")
    part = F.col("many") / (F.col("n") - F.ceil(F.col("n") * LIKENESS[0] / LIKENESS[1]) + 1)
    shared = materialize(keys.join(one.drop("h"), "digest").select("key", F.struct("digest", "n", "fp", part.alias("part")).alias("d")), "shared_sets")
    hubs = materialize(shared.groupBy("key").agg(F.max_by("d", F.struct("d.part", "d.digest")).alias("hub"), F.count("*").alias("rows")), "hubs")
    met = materialize(spread_join(shared, hubs, "key", "rows").select("key", "rows", "d", F.when(_may_be_near(F.col("d"), F.col("hub")), F.col("hub.digest")).alias("hub")), "met")
    pairs = met.where("hub is not null and hub <> d.digest").select(F.least("d.digest", "hub").alias("a"), F.greatest("d.digest", "hub").alias("b")).distinct()
    lists = met.groupBy("d.digest").agg(F.first("d.n").alias("n"), F.first("d.fp").alias("fp"), F.sort_array(F.collect_list(F.struct("rows", "key"))).alias("keys"))
    lists = materialize(lists.join(one.select("digest", "h"), "digest"), "key_lists")
    first = confirmed(docs, pairs, lists)
    roots = materialize(members(components(first), "digest"), "roots")
    rooted = lists.drop("h").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    placed = materialize(rooted.select("digest", "n", "fp", "root", F.size("keys").alias("many"), F.posexplode("keys").alias("place", "k")).select("digest", "n", "fp", "root", "many", (F.col("place") + 1).alias("place"), "k.rows", "k.key"), "placed")
    mixed = materialize(placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.first("rows").alias("rows")).where("r < s and rows > 2").select("key", "rows"), "mixed")
    second = confirmed(docs, pairs_in_tiles(spread_join(placed.drop("rows"), mixed, "key", "rows").drop("rows")), lists)
    return components(first.unionByName(second))


def placed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, h, least (the least doc_id and text hash that its links reach) of each row with a doc_id."""
    docs = docs.where(F.col("doc_id").isNotNull())
    rows = materialize(marks(docs), "marks")
    root = materialize(members(likeness_roots(docs, rows), "digest"), "near_roots")
    one = materialize(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count("*").alias("n")), "digests")
    own = one.join(root, "digest")
    by_root = own.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("__n"))
    linked = spread_join(own.select("digest", "n", "root"), by_root, "root", "__n").select("digest", "n", "least")
    every = materialize(linked.unionByName(one.join(root, "digest", "left_anti").select("digest", "n", "least")), "near_components")
    return spread_join(rows.select("doc_id", "h", "digest"), every, "digest").select("doc_id", "h", "least")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id for every row of docs with a doc_id.

    Texts whose sets of five-word shingles (the whole of a shorter text; letters in lower
    case) have a Jaccard index of 0.8 or more link; component_id is the least doc_id that
    links reach. Texts without words are alike. Null texts are empty; repeated rows are in
    one group. Other columns are not read; an empty table gives an empty result.
    """
    return placed_rows(docs).select("doc_id", F.col("least.doc_id").alias("component_id"))


def keep_first_of_near(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near_groups: that of the least doc_id and text hash.

    Rows, not ids, are kept or dropped: where one doc_id has several texts, each stays or
    goes with its own group. Of rows alike in doc_id and text any one stays. Rows without a
    doc_id stay, and all columns as they are. Null texts are empty; an empty table stays empty.
    """
    return first_only(docs, materialize(placed_rows(docs), "placed_rows"))
