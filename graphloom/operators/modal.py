"""Modal logic over frames: worlds, accessibility per relation, and where propositions hold.

worlds: world; access: rel, w1, w2; a proposition is a column of worlds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut


def diamond(access: DataFrame, rel: str, holds: DataFrame) -> DataFrame:
    """Worlds from which some accessible world has the proposition."""
    a = access.where(F.col("rel") == rel)
    return a.join(holds.toDF("w2"), "w2", "left_semi").select(F.col("w1").alias("world")).distinct()


def box(worlds: DataFrame, access: DataFrame, rel: str, holds: DataFrame) -> DataFrame:
    """Worlds all of whose accessible worlds have the proposition; those that reach none do too."""
    a = access.where(F.col("rel") == rel)
    bad = a.join(holds.toDF("w2"), "w2", "left_anti").select(F.col("w1").alias("world")).distinct()
    return worlds.select("world").join(bad, "world", "left_anti")


def frame_properties(worlds: DataFrame, access: DataFrame, rel: str) -> dict[str, bool]:
    """Whether a relation is reflexive, symmetric, transitive, serial and Euclidean."""
    a = access.where(F.col("rel") == rel).select("w1", "w2").distinct()
    w = worlds.select("world").distinct()
    lacking = lambda wanted: wanted.join(a, ["w1", "w2"], "left_anti").isEmpty()
    two = a.toDF("x", "y")
    return {
        "reflexive": lacking(w.select(F.col("world").alias("w1"), F.col("world").alias("w2"))),
        "symmetric": lacking(a.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"))),
        "transitive": lacking(two.join(a, F.col("y") == F.col("w1")).select(F.col("x").alias("w1"), "w2")),
        "serial": w.join(a.select(F.col("w1").alias("world")), "world", "left_anti").isEmpty(),
        "euclidean": lacking(two.join(a, F.col("x") == F.col("w1")).select(F.col("y").alias("w1"), "w2")),
    }


def knows(worlds: DataFrame, access: DataFrame, agent: str, holds: DataFrame) -> DataFrame:
    return box(worlds, access, agent, holds)


def common_knowledge(worlds: DataFrame, access: DataFrame, agents: list[str], holds: DataFrame, depth: int = 10) -> DataFrame:
    """Worlds where all know, and all know that all know, and so on, down to a depth or a fixpoint."""
    now = holds.toDF("world").distinct()
    for _ in range(depth):
        new = now
        for a in agents:
            new = new.join(box(worlds, access, a, now), "world", "left_semi")
        new = cut(new)
        if now.join(new, "world", "left_anti").isEmpty():
            return new
        now = new
    return now


def obligatory(worlds: DataFrame, access: DataFrame, holds: DataFrame, ideal: str = "ideal") -> DataFrame:
    return box(worlds, access, ideal, holds)


def permitted(access: DataFrame, holds: DataFrame, ideal: str = "ideal") -> DataFrame:
    return diamond(access, ideal, holds)


def forbidden(worlds: DataFrame, access: DataFrame, holds: DataFrame, ideal: str = "ideal") -> DataFrame:
    """Worlds in whose ideal worlds the proposition never holds."""
    return worlds.select("world").join(permitted(access, holds, ideal), "world", "left_anti")


def entity_query(frame: DataFrame, access: DataFrame, modality: str, rel: str, entities: DataFrame) -> DataFrame:
    """id of the entities whose worlds box or diamond finds, for a proposition given by entities. frame: world, entity."""
    holds = frame.join(entities.toDF("entity"), "entity", "left_semi").select("world").distinct()
    found = diamond(access, rel, holds) if modality == "diamond" else box(frame.select("world").distinct(), access, rel, holds)
    return frame.join(found, "world", "left_semi").select(F.col("entity").alias("id")).distinct()
