"""Fixity audit of an archive's replicas by Merkle trees.

The leaves are an archive's records, in order of their position. A record's digest is the
SHA-256 of its fields. A node of the lowest level covers a range of FANOUT positions, a
node above it FANOUT nodes; its digest is the SHA-256 of its children's (number, digest)
in order, and it knows how many records and bytes lie below it. Two replicas are compared
from the roots down: only children of nodes that differ are joined, so what is compared is
in proportion to the damage, and a damaged record is located by its range of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

FANOUT_BITS = 6
FANOUT = 1 << FANOUT_BITS


def record_digest(columns: list[str]) -> Column:
    """SHA-256 over the fields, each with its length before it; a null differs from an empty one."""
    fields = []
    for c in columns:
        b = F.col(c).cast("string").cast("binary")
        fields += [F.coalesce(F.length(b).cast("string"), F.lit("-")).cast("binary"), F.lit(":").cast("binary"), F.coalesce(b, F.lit("").cast("binary"))]
    return F.sha2(F.concat(*fields), 256)


def record_bytes(columns: list[str]) -> Column:
    out = F.lit(0).cast("bigint")
    for c in columns:
        out = out + F.coalesce(F.octet_length(F.col(c).cast("string").cast("binary")).cast("bigint"), F.lit(0))
    return out


def leaves(records: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """node (position), digest, n_records, n_bytes: one row for each position.

    Records that share a position are one leaf: the digest is then over the sum of each
    quarter of their digests, so it depends on which records there are and how many of
    each, not on their order, and nothing is gathered. Records without a position are the
    leaf -1.
    """
    one = records.select(F.coalesce(F.col(position).cast("bigint"), F.lit(-1)).alias("node"), record_digest(columns).alias("d"), record_bytes(columns).alias("b"))
    quarters = [F.sum(F.conv(F.substring("d", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"q{i}") for i in range(4)]
    by = one.groupBy("node").agg(F.count("*").alias("n_records"), F.sum("b").alias("n_bytes"), F.min("d").alias("least"), *quarters)
    many = F.sha2(F.concat_ws("/", F.col("n_records").cast("string"), *(F.col(f"q{i}").cast("string") for i in range(4))), 256)
    return by.select("node", F.when(F.col("n_records") == 1, F.col("least")).otherwise(many).alias("digest"), "n_records", "n_bytes")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: FANOUT children at most are gathered into a node."""
    grouped = nodes.groupBy(F.shiftright("node", FANOUT_BITS).alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"), F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes")
    )
    own = F.sha2(F.array_join(F.transform("c", lambda x: F.concat((x["node"]).cast("string"), F.lit("="), x["digest"])), ";"), 256)
    return grouped.select(F.col("up").alias("node"), own.alias("digest"), "n_records", "n_bytes")


def merkle_tree(records: DataFrame, position: str, columns: list[str], levels: int | None = None, name: str = "tree") -> list[DataFrame]:
    """The levels of a tree, leaves first; each is written to the shared folder.

    Without `levels` the tree grows until one node (or two: positions below zero and
    others) is left; two trees to be compared need equally many levels.
    """
    out = [materialize(leaves(records, position, columns), f"{name}0")]
    while levels is None or len(out) < levels:
        if levels is None:
            ends = out[-1].agg(F.min("node"), F.max("node")).first()
            if ends[0] is None or {ends[0], ends[1]} <= {-1, 0}:
                break
        out.append(materialize(parents(out[-1]), f"{name}{len(out)}"))
    return out


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """position, kind, digests, counts, range_start, range_end of every record position that differs.

    kind: 'missing' (in the primary alone), 'extra' (in the replica alone), 'changed', or
    'repeated' (as many bytes differ as a whole number of the same records). The range is
    that of the position's bytes in the primary; what the replica has in addition has an
    empty range where it would stand.
    """
    if len(primary) != len(replica):
        raise ValueError("the trees have different heights")
    suspects = None
    for level in range(len(primary) - 1, -1, -1):
        a, b = primary[level], replica[level]
        if suspects is None:
            # Records without a position, under the node -1, come first.
            before = a.select((F.when(F.col("node") < 0, F.col("n_bytes"))).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0))).first()[0]
            a = a.withColumn("start", F.when(F.col("node") < 0, F.lit(0)).otherwise(F.lit(before)).cast("bigint"))
        else:
            up = F.shiftright("node", FANOUT_BITS)
            held = suspects.select(F.col("node").alias("up"), F.col("start").alias("base"))
            a = a.withColumn("up", up).join(held, "up")
            b = b.withColumn("up", up).join(held.select("up"), "up", "left_semi")
            # Where a child begins: its parent's start and its elder siblings' bytes, FANOUT at most.
            elder = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
            a = a.withColumn("start", F.col("base") + F.coalesce(F.sum("n_bytes").over(elder), F.lit(0)))
        left = a.select("node", "start", F.col("digest").alias("digest_a"), F.col("n_records").alias("records_a"), F.col("n_bytes").alias("bytes_a"))
        right = b.select("node", F.col("digest").alias("digest_b"), F.col("n_records").alias("records_b"), F.col("n_bytes").alias("bytes_b"))
        differ = left.join(right, "node", "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        # What the primary lacks begins where its branch does.
        if suspects is not None:
            gap = suspects.select(F.col("node").alias("up"), F.col("start").alias("gap"))
            differ = differ.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(gap, "up").withColumn("start", F.coalesce("start", "gap")).drop("up", "gap")
        else:
            differ = differ.withColumn("start", F.coalesce("start", F.lit(0)))
        suspects = materialize(differ, f"audit{level}")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").when(F.col("records_a") != F.col("records_b"), "repeated").otherwise("changed")
    return suspects.select(
        F.col("node").alias("position"), kind.alias("kind"), F.col("digest_a").alias("primary_digest"), F.col("digest_b").alias("replica_digest"), n("records_a").alias("primary_records"), n("records_b").alias("replica_records"),
        F.col("start").alias("range_start"), (F.col("start") + n("bytes_a")).alias("range_end"),
    )


def fixity_audit(primary: DataFrame, replica: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """audit() of two tables of records.

    Tables may be empty, hold repeated rows or rows without a position (all of which are
    one leaf, -1), nulls and empty fields, which differ. Equal tables give no row. Columns
    that are not named are not read.
    """
    a = merkle_tree(primary, position, columns, name="primary")
    b = merkle_tree(replica, position, columns, name="replica")
    # The lower tree is raised to the height of the other.
    while len(a) < len(b):
        a.append(materialize(parents(a[-1]), f"primary{len(a)}"))
    while len(b) < len(a):
        b.append(materialize(parents(b[-1]), f"replica{len(b)}"))
    return audit(a, b)


def damaged(pages: DataFrame) -> DataFrame:
    """A stand-in for a second replica of pages: a copy with bit rot, losses, repeats and strays.

    By the MD5 of the page's id: some records have a byte of their payload changed, some
    are lost, some stand twice, and some have another URL. All other records are as they were.
    """
    c = F.coalesce(F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(0))
    out = pages.where(c % 211 != 3)
    out = out.withColumn("html", F.when(c % 199 == 5, F.concat(F.lit("\x00"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    out = out.withColumn("url", F.when(c % 197 == 7, F.concat("url", F.lit("#"))).otherwise(F.col("url")))
    return out.withColumn("__n", F.explode(F.when(c % 193 == 11, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__n")
