"""Reconciliation of weighted facts: conflicts, votes, decay, and a fold over arrivals.

facts: fact_id, subject, attribute, value, weight, source, arrived (an order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.prob import clamp, decayed


def conflicts(facts: DataFrame) -> DataFrame:
    """Pairs of facts that give one subject's attribute different values."""
    a = facts.select("subject", "attribute", F.col("fact_id").alias("a"), F.col("value").alias("value_a"), F.col("weight").alias("weight_a"))
    b = facts.select("subject", "attribute", F.col("fact_id").alias("b"), F.col("value").alias("value_b"), F.col("weight").alias("weight_b"))
    return a.join(b, ["subject", "attribute"]).where((F.col("a") < F.col("b")) & (F.col("value_a") != F.col("value_b")))


def reconcile(facts: DataFrame, gap: float = 0.2, expert_weight: float = 0.95) -> DataFrame:
    """What is left of the arrivals, folded in their order for each subject and attribute.

    The same value again merges (noisy-or of weights). Against another value an expert's
    weight wins; a gap of `gap` replaces or keeps; half of it keeps the heavier and marks
    it merged; less leaves it for review.
    """

    def made(value: Column, weight: Column, fact_id: Column, state: Column, merged: Column) -> Column:
        return F.struct(value.alias("value"), weight.alias("weight"), fact_id.alias("fact_id"), state.alias("state"), merged.alias("merged"))

    def step(held: Column, x: Column) -> Column:
        d = x["weight"] - held["weight"]
        own = held["value"], held["weight"], held["fact_id"]
        new = x["value"], x["weight"], x["fact_id"]
        return (
            F.when(x["value"] == held["value"], made(held["value"], 1 - (1 - held["weight"]) * (1 - x["weight"]), held["fact_id"], held["state"], held["merged"] + 1))
            .when(((x["weight"] >= expert_weight) & (held["weight"] < expert_weight)) | (d >= gap), made(*new, F.lit("replaced"), held["merged"]))
            .when(d <= -gap, made(*own, F.lit("kept"), held["merged"]))
            .when(d >= gap / 2, made(*new, F.lit("merged"), held["merged"] + 1))
            .when(d <= -gap / 2, made(*own, F.lit("merged"), held["merged"] + 1))
            .otherwise(made(*own, F.lit("review"), held["merged"]))
        )

    arrival = F.struct("arrived", F.col("fact_id").cast("bigint").alias("fact_id"), "value", F.col("weight").cast("double").alias("weight"))
    v = facts.groupBy("subject", "attribute").agg(F.sort_array(F.collect_list(arrival)).alias("v"))
    first = F.col("v")[0]
    held = F.aggregate(F.slice("v", 2, F.size("v")), made(first["value"], first["weight"], first["fact_id"], F.lit("kept"), F.lit(0).cast("bigint")), step)
    return v.select("subject", "attribute", held.alias("h")).select("subject", "attribute", "h.*")


def voted(weights: DataFrame, votes: DataFrame, up: float = 0.1, down: float = 0.15) -> DataFrame:
    """fact_id, weight after votes (fact_id, ts, kind: support, refute or neutral, strength), in the order of time."""
    v = votes.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("ts", "kind", "strength"))).alias("v"))

    def step(w: Column, x: Column) -> Column:
        return F.when(x["kind"] == "support", clamp(w + (1 - w) * up * x["strength"])).when(x["kind"] == "refute", clamp(w - w * down * x["strength"])).otherwise(w)

    j = weights.join(v, "fact_id", "left")
    return j.select("fact_id", F.when(F.col("v").isNull(), F.col("weight").cast("double")).otherwise(F.aggregate("v", F.col("weight").cast("double"), step)).alias("weight"))


def decay_all(facts: DataFrame, now, half_life_days: float = 30.0, least: float = 0.1) -> DataFrame:
    """facts (weight, ts, ...) with decayed weights; those under `least` go."""
    return facts.withColumn("weight", decayed(F.col("weight"), F.col("ts"), now, half_life_days)).where(F.col("weight") >= least)
