"""Document fingerprints by winnowing, in DataFrame functions alone.

Each run of K words is hashed, and of every WINDOW neighbouring hashes the least is kept,
the rightmost of equal ones, with its position. Any passage of K + WINDOW - 1 words that
two texts share is therefore in both fingerprints; shorter than K words, a text is hashed
as a whole. Characters of scripts that put no spaces between words are words of their own.

The hash is a polynomial modulo 2**31 - 1 over the hashes of words, rolled by doubling: a
word is hashed once, and runs of 2, 4, ... words are put together from two of half their
length, all places at a time. The minima of windows are found in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

K, WINDOW = 5, 8
_LAST = (1 << 31) - 1  # of positions: a hash stands in the bits above
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
#: Characters that a block of neighbouring documents holds, about, and how many blocks there are at most; beyond, blocks grow.
BLOCK_CHARS, MOST_BLOCKS = 4_000_000, 8192
#: Thai to Myanmar, Khmer, kana, Han characters and Hangul.
UNSPACED = "[\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff\\x{20000}-\\x{3134f}]"


def _followed_by(length: int):
    """The hash of two runs in a row, the second of so many words."""
    shift = pow(BASE, length, PRIME)
    return lambda x, y: (x * F.lit(shift).cast("bigint") + y) % PRIME


def _beside(column: str, distance: int, both, other: str | None = None) -> Column:
    """both(x, y) of each element and the one `distance` after it, of another column if named."""
    left, right = F.col(column), F.col(other or column)
    n = F.greatest(F.least(F.size(left), F.size(right) - distance), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(distance + 1), n), both)


def with_prints(df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df and, as `name`, the fingerprint of a text column: longs in the order of positions.

    A long is hash * 2**31 + (2**31 - 1 - position): the least of them is the least hash,
    and of equal hashes the rightmost.
    """
    columns = df.columns
    words, one, grams, keyed = (f"__{name}_{x}" for x in ("words", "hashes", "grams", "keyed"))
    spaced = F.when(F.col(text).rlike(UNSPACED), F.regexp_replace(F.col(text), UNSPACED, " $0 ")).otherwise(F.col(text))
    # Only a text's ends can leave an empty word.
    df = df.withColumn(words, F.array_remove(F.split(spaced, r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn(one, F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME).cast("bigint"))))
    # Runs of powers of two, and then of k as the sum of some.
    at, length, run = one, 1, None
    built, rest = 0, k
    while rest:
        if rest & 1:
            if run is None:
                run, built = at, length
            else:
                out = f"__{name}_run{built + length}"
                df = df.withColumn(out, _beside(run, built, _followed_by(length), at))
                run, built = out, built + length
        rest >>= 1
        if rest:
            out = f"__{name}_pow{2 * length}"
            df = df.withColumn(out, _beside(at, length, _followed_by(length)))
            at, length = out, 2 * length
    whole = F.aggregate(one, F.lit(0).cast("bigint"), lambda a, x: (a * F.lit(BASE).cast("bigint") + x) % PRIME)
    df = df.withColumn(grams, F.when(F.size(words) >= k, F.col(run)).when(F.size(words) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(keyed, F.transform(grams, lambda h, i: F.shiftleft(h, 31).bitwiseOR((F.lit(_LAST) - i).cast("bigint"))))
    least, length = keyed, 1
    while 2 * length <= window:
        out = f"__{name}_least{2 * length}"
        df = df.withColumn(out, _beside(least, length, lambda x, y: F.least(x, y)))
        least, length = out, 2 * length
    if length < window:
        out = f"__{name}_least{window}"
        df = df.withColumn(out, _beside(least, window - length, lambda x, y: F.least(x, y)))
        least = out
    df = df.withColumn(name, F.when(F.size(keyed) > window, F.array_distinct(least)).when(F.size(keyed) > 0, F.array(F.array_min(keyed))).otherwise(F.array().cast("array<bigint>")))
    return df.select(*columns, name)


def shown(prints: Column) -> Column:
    """A fingerprint as text: hash@position, comma-joined."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit("@"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"))), ",")


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard's index of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(a) + F.size(b) - both
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def _block_bounds(own: DataFrame, block_chars: int) -> list[int]:
    """Ids at which blocks of about block_chars characters begin, MOST_BLOCKS at most."""
    total = own.agg(F.sum(F.length("text").cast("bigint")).alias("chars"), F.min("doc_id").alias("least")).first()
    if total.least is None:
        return []
    blocks = min(MOST_BLOCKS, max(1, -(-total.chars // block_chars)))
    if blocks == 1:
        return [total.least]
    cuts = own.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], min(1_000_000, 100 * blocks)).alias("cuts")).first().cuts
    return sorted({*cuts, total.least})


def neighbours(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, WindowSpec]:
    """doc_id, text, __block, __extra, and the window by which lead() finds the next document.

    Documents are dealt to blocks of neighbouring ids, whose bounds are ids that exist, a
    task for each block; each block's first document also stands (__extra > 0) at the end
    of the block before it, and the first of all at the end of the last. A window over one
    block so finds every successor, in one shuffle. Rows without a doc_id have none and
    are spread over all blocks.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _block_bounds(own, block_chars)
    n = max(1, len(bounds))
    known = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    own = own.withColumn("__block", F.lit(0))
    step = 1 << len(bounds).bit_length()
    while step:  # the number of bounds that are not above the id, bit by bit
        own = own.withColumn("__block", F.when(F.coalesce(F.try_element_at(known, F.col("__block") + step) <= F.col("doc_id"), F.lit(False)), F.col("__block") + step).otherwise(F.col("__block")))
        step //= 2
    own = own.withColumn("__block", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int") + 1).otherwise(F.col("__block")))
    first = F.coalesce(F.try_element_at(known, F.greatest("__block", F.lit(1))) == F.col("doc_id"), F.lit(False))
    before = F.when(F.col("__block") > 1, F.struct((F.col("__block") - 1).alias("b"), F.lit(1).alias("extra"))).otherwise(F.struct(F.lit(n).alias("b"), F.lit(2).alias("extra")))
    here = F.struct(F.col("__block").alias("b"), F.lit(0).alias("extra"))
    dealt = own.select("doc_id", "text", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))).alias("__place"))
    dealt = dealt.select("doc_id", "text", (F.col("__place.b") - 1).alias("__block"), F.col("__place.extra").alias("__extra")).repartitionById(n, "__block")
    return dealt, Window.partitionBy("__block").orderBy(F.col("doc_id").isNull(), "__extra", "doc_id", "text")


def winnow_documents(docs: DataFrame, k: int = K, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text is the document's own with its last floor(n_chars / 2) code points
    replaced by the first as many of the next document's (or by all of them). Equal texts
    have equal fingerprints; a text without words has an empty one, and two empty ones are
    alike (1). Null texts are empty. Rows that repeat a doc_id follow one another by their
    text; rows without a doc_id are followed by nothing, which is an empty text. Other
    columns are not read; an empty table gives an empty result.
    """
    dealt, order = neighbours(docs, block_chars)
    own = with_prints(dealt, "text", "__prints", k, window)
    led = own.withColumns({"__next": F.lead("text").over(order), "__next_prints": F.lead("__prints").over(order)}).where("__extra = 0")
    known = F.col("doc_id").isNotNull()
    led = led.withColumns({"__next": F.when(known, F.col("__next")), "__next_prints": F.when(known, F.col("__next_prints"))})
    led = led.withColumn("n_chars", F.length("text")).withColumn("__half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = led.withColumn("__edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.col("__half")), F.substring(F.coalesce("__next", F.lit("")), F.lit(1), F.col("__half"))))
    both = with_prints(edited.select("doc_id", "n_chars", "__edited", "__prints", "__next_prints"), "__edited", "__edited_prints", k, window)
    out = both.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"), shown(F.col("__prints")).alias("fingerprint"), shown(F.col("__edited_prints")).alias("edited_fingerprint"),
        hashes(F.col("__prints")).alias("__h"), hashes(F.col("__edited_prints")).alias("__e"), hashes(F.coalesce("__next_prints", F.array().cast("array<bigint>"))).alias("__n"),
    )
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("__h"), F.col("__e")).alias("near_edited"), likeness(F.col("__h"), F.col("__n")).alias("near_next"))
