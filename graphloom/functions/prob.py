"""Probabilities, weights and decay, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = 1_000_000


def fixed(p: Column) -> Column:
    """A probability in millionths, rounded half up."""
    return F.floor(p.cast("double") * ONE + 0.5).cast("bigint")


def fixed_product(ps: Column) -> Column:
    """The product of an array of probabilities in millionths, rounded down at each step."""
    return F.aggregate(ps, F.lit(ONE).cast("bigint"), lambda a, p: F.floor(a * p / ONE).cast("bigint"))


def complement(p: Column) -> Column:
    return 1 - p


def both(p: Column, q: Column) -> Column:
    return p * q


def either(p: Column, q: Column) -> Column:
    return p + q - p * q


def clamp(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def bayes(prior: Column, likelihood: Column, evidence: Column) -> Column:
    return F.when(evidence == 0, prior).otherwise(clamp(likelihood * prior / evidence))


def combine(a: Column, b: Column) -> Column:
    return clamp(either(a, b))


def credibility(base: Column, expertise: Column, correct: Column, total: Column) -> Column:
    """A source's standing: base, expertise in the domain (0.5 if unknown), and accuracy once there are outcomes."""
    return clamp(base * F.coalesce(expertise, F.lit(0.5)) * F.when(total > 0, correct / total).otherwise(1.0))


def decayed(weight: Column, then: Column, now: Column, half_life_days: float) -> Column:
    days = (F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0
    return weight * F.pow(F.lit(0.5), days / half_life_days)


def decide(a: Column, b: Column, threshold: int) -> Column:
    """Of two confidences in millionths: a clear gap chooses, half of one merges, less is for review."""
    gap = F.abs(a - b)
    return F.when(gap >= threshold, F.when(a > b, "choose_first").otherwise("choose_second")).when(gap * 2 >= threshold, "merge").otherwise("review")
