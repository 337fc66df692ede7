"""Text functions of the query language, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = "the of and to in a is for on with as by at an or".split()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def lower_literal(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def tokens(c: Column) -> Column:
    """Search tokens: runs of ASCII letters and digits, cut before a capital that follows a letter.

    Lower-cased, 64 characters at most, two at least, without stop words.
    """
    parted = F.regexp_replace(c, "(?<=[A-Za-z])(?=[A-Z])", " ")
    parts = F.transform(F.split(parted, "[^A-Za-z0-9]+"), lambda t: F.substring(ascii_lower(t), 1, 64))
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def tokens_literal(s: str) -> list[str]:
    import re

    parts = re.split("[^A-Za-z0-9]+", re.sub("(?<=[A-Za-z])(?=[A-Z])", " ", s))
    return [t for t in (lower_literal(p)[:64] for p in parts) if len(t) >= 2 and t not in STOPWORDS]


def contains(value: Column, needle: str) -> Column:
    """Whether a trimmed needle stands in a value, whatever the case of ASCII letters; an empty one never does."""
    n = lower_literal(needle.strip())
    return F.lit(False) if not n else ascii_lower(value).contains(n)


def has_all_tokens(value: Column, query: str) -> Column:
    want = sorted(set(tokens_literal(query)))
    return F.lit(False) if not want else F.size(F.array_except(F.array(*map(F.lit, want)), tokens(value))) == 0


def has_any_token(value: Column, query: str) -> Column:
    want = sorted(set(tokens_literal(query)))
    return F.lit(False) if not want else F.arrays_overlap(F.array(*map(F.lit, want)), tokens(value))


def fuzzy(value: Column, needle: str, distance: int) -> Column:
    """Levenshtein distance of at most min(distance, 16), whatever the case of ASCII letters."""
    n = lower_literal(needle.strip())
    return F.lit(False) if not n else F.levenshtein(ascii_lower(value), F.lit(n), min(distance, 16)) >= 0


def name_key(c: Column) -> Column:
    """A name as a key: lower case, and runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def statement_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def identifier(c: Column) -> Column:
    """A string as an identifier: other characters become underscores, and a leading digit gets one before it."""
    x = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(x.rlike("^[0-9]") | (x == ""), F.concat(F.lit("_"), x)).otherwise(x)


def keywords(c: Column) -> Column:
    """Distinct lower-case words of more than two characters that are no stop words."""
    stop = [*STOPWORDS, "what", "how", "why", "when", "where", "who", "which", "does", "are", "was", "can", "this", "that", "from"]
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{Alnum}]+"), lambda t: (F.length(t) > 2) & ~t.isin(stop)))
