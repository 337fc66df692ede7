"""Migration of data along a schema morphism by pullback.

An instance has objects (obj, elem) and arrows (arrow, src, dst). A morphism maps each
object of the source schema to one of the target's, and each arrow to a path of arrows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Morphism:
    objects: dict[str, str]
    arrows: dict[str, tuple[str, ...]]

    def then(self, after: Morphism) -> Morphism:
        """This one and then another: paths of paths are strung together."""
        return Morphism({a: after.objects[b] for a, b in self.objects.items()}, {a: tuple(x for b in path for x in after.arrows[b]) for a, path in self.arrows.items()})


def pullback(morphism: Morphism, source_arrows: dict[str, tuple[str, str]], objects: DataFrame, arrows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The source schema's instance from the target's: objects copied, arrows composed along their paths.

    source_arrows: arrow -> (from, to). An empty path is the identity.
    """
    spark = objects.sparkSession
    objs = [objects.where(F.col("obj") == t).select(F.lit(s).alias("obj"), "elem") for s, t in morphism.objects.items()]
    arr = []
    for name, (a, _) in source_arrows.items():
        at = objects.where(F.col("obj") == morphism.objects[a]).select(F.col("elem").alias("src"), F.col("elem").alias("dst"))
        for step in morphism.arrows[name]:
            f = arrows.where(F.col("arrow") == step).select(F.col("src").alias("dst"), F.col("dst").alias("to"))
            at = at.join(f, "dst").select("src", F.col("to").alias("dst"))
        arr.append(at.select(F.lit(name).alias("arrow"), "src", "dst"))
    none = spark.createDataFrame([], "arrow string, src string, dst string")
    return reduce(DataFrame.unionByName, objs), reduce(DataFrame.unionByName, arr, none) if arr else none


def instance_errors(schema_arrows: dict[str, tuple[str, str]], objects: DataFrame, arrows: DataFrame) -> DataFrame:
    """arrow, elem, problem: elements without a value, with several, or with one outside the codomain."""
    out = [objects.sparkSession.createDataFrame([], "arrow string, elem string, problem string")]
    for name, (a, b) in schema_arrows.items():
        f = arrows.where(F.col("arrow") == name)
        dom = objects.where(F.col("obj") == a).select(F.col("elem").alias("src"))
        cod = objects.where(F.col("obj") == b).select(F.col("elem").alias("dst"))
        say = lambda df, c, p: df.select(F.lit(name).alias("arrow"), F.col(c).cast("string").alias("elem"), F.lit(p).alias("problem"))  # noqa: B023, E731
        out += [say(dom.join(f, "src", "left_anti"), "src", "missing"), say(f.groupBy("src").count().where("count > 1"), "src", "duplicate"), say(f.join(cod, "dst", "left_anti"), "dst", "outside the codomain")]
    return reduce(DataFrame.unionByName, out)
