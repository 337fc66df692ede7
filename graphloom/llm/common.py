"""Shared helpers: the shared folder, whole-table readers, Arrow tokenisation and hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at a time; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its rows are then fixed, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, side: DataFrame, key: str, count: str = "n", many: int = 1000, least: int = 100) -> DataFrame:
    """rows joined with side, which has one row for each key and in `count` how many rows hold it.

    The `many` keys of most rows (and more than `least`) are sent to all tasks, so their
    rows stay where they are, however many; all other rows meet by their key.
    """
    hot = materialize(side.where(F.col(count) > least).orderBy(F.desc(count), key).limit(many), "hot_keys")
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side, key)
    return left.unionByName(rows.join(F.broadcast(hot), key))


#: Bits of a map of values: with its words as rows it is sent to all tasks, a few megabytes whatever the number of values.
MAP_BITS = 23


def may_be_in(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """df with __maybe: false where the long in `key` is surely not among those of values (one column); true for all that are.

    Few of the others are true as long as the values are fewer than the map's bits.
    """
    slot = F.pmod(F.col(values.columns[0]), F.lit(1 << MAP_BITS).cast("long")).alias("slot")
    words = materialize(values.select(slot).groupBy(F.shiftright("slot", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("__bits")), "map")
    slots = df.withColumn("__slot", F.pmod(F.col(key), F.lit(1 << MAP_BITS).cast("long"))).withColumn("__word", F.shiftright("__slot", 6))
    told = slots.join(F.broadcast(words), "__word", "left")
    bit = F.expr("shiftright(__bits, cast(__slot % 64 as int)) & 1")
    return told.select(*df.columns, F.coalesce(bit == 1, F.lit(False)).alias("__maybe"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str, modulus: int):
    """crc32(doc_id as text) mod modulus; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about `limit` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in a row, and how many each text has (null: none)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = parts.flatten()
    owner = np.repeat(np.arange(len(text)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    keep = pc.greater(pc.binary_length(flat), 0)
    owner = owner[keep.to_numpy(zero_copy_only=False)]
    return flat.filter(keep), np.bincount(owner, minlength=len(text)).astype(np.int64)


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each run begins, given the lengths of the runs."""
    out = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=out[1:])
    return out


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(first - starts(count), count)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxh64_lanes(view: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of equally long spans, a lane each."""
    s, p, end = np.uint64(seed), 0, length
    if length >= 32:
        acc = [np.full(len(at), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        while p <= end - 32:
            for j in range(4):
                acc[j] = _rotl(acc[j] + view[at + (p + 8 * j)] * _P2, 31) * _P1
            p += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for v in acc:
            h = (h ^ (_rotl(v * _P2, 31) * _P1)) * _P1 + _P4
    else:
        h = np.full(len(at), s + _P5, np.uint64)
    h = h + np.uint64(length)
    while p <= end - 8:
        h = _rotl(h ^ (_rotl(view[at + p] * _P2, 31) * _P1), 27) * _P1 + _P4
        p += 8
    if p < end:
        rest = view[at + p]  # the buffer is padded, so this never runs out
        if end - p >= 4:
            h = _rotl(h ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            rest = rest >> np.uint64(32)
            p += 4
        while p < end:
            h = _rotl(h ^ ((rest & np.uint64(0xFF)) * _P5), 11) * _P1
            rest = rest >> np.uint64(8)
            p += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(data: bytes, at: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[at[i]:at[i]+length[i]] for every i, by lanes of equal length."""
    out = np.empty(len(at), np.uint64)
    if not len(at):
        return out
    padded = data + bytes(8)
    view = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            lanes = order[a:b]
            if b - a < 16:
                for i in lanes.tolist():
                    p = int(at[i])
                    out[i] = xxhash.xxh64_intdigest(data[p : p + size], seed)
            else:
                out[lanes] = _xxh64_lanes(view, at[lanes], size, seed)
    return out


def joined(words: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words joined by spaces, and where each begins and how long it is, in bytes."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    whole = pc.binary_join(one, " ")[0].as_buffer() if len(words) else None
    return (whole.to_pybytes() if whole is not None else b""), starts(size + 1), size
