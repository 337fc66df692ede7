"""Drift, cost, coverage, calibration, aggregation of extracted facts, and belief propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import name_key, statement_key
from graphloom.plans.fixpoint import cut
from graphloom.snapshot import Graph

WEIGHTS = {"error": 10.0, "warning": 2.0, "info": 0.5, "fact_type": 10.0, "rewrite_rule": 8.0, "context": 5.0, "modal": 5.0}


def relation_counts(graph: Graph, ctx: int | None = None) -> DataFrame:
    """relation, n of the facts of a context, or of all."""
    f = graph.facts if ctx is None else graph.facts.join(graph.fact_context.where(F.col("ctx_id") == ctx).select("fact_id").distinct(), "fact_id", "left_semi")
    return f.groupBy("relation").agg(F.count("*").alias("n"))


def drift(a: DataFrame, b: DataFrame, key: str, alpha: float = 1.0, kind: str = "js") -> DataFrame:
    """One row (divergence, n_a, n_b, support) of two histograms (key, n), smoothed over their joint support; natural logarithms.

    kind: 'kl' of a from b, or 'js'.
    """
    j = _distributions(a, b, key, alpha)
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    term = kl(F.col("p"), F.col("q")) if kind == "kl" else (kl(F.col("p"), m) + kl(F.col("q"), m)) / 2
    return j.agg(F.sum(term).alias("divergence"), F.max("total_a").alias("n_a"), F.max("total_b").alias("n_b"), F.count("*").alias("support"))


def drift_terms(a: DataFrame, b: DataFrame, key: str, alpha: float = 1.0, k: int = 10) -> DataFrame:
    """What moved most: key, p, q, and their difference."""
    j = _distributions(a, b, key, alpha)
    return j.select(key, "p", "q", (F.col("p") - F.col("q")).alias("difference")).orderBy(F.desc(F.abs("difference")), key).limit(k)


def _distributions(a: DataFrame, b: DataFrame, key: str, alpha: float) -> DataFrame:
    j = a.select(key, F.col("n").alias("na")).join(b.select(key, F.col("n").alias("nb")), key, "full").select(key, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    total = j.agg(F.sum("na").alias("total_a"), F.sum("nb").alias("total_b"), F.count("*").alias("support"))
    j = j.crossJoin(F.broadcast(total))  # one row
    p = lambda n, t: F.when(F.col(t) + alpha * F.col("support") > 0, (F.col(n) + alpha) / (F.col(t) + alpha * F.col("support"))).otherwise(0.0)
    return j.select(key, "total_a", "total_b", p("na", "total_a").alias("p"), p("nb", "total_b").alias("q"))


def guardrail_cost(findings: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """level, n, weight, cost of findings by level; the sum of the costs is the graph's."""
    w = findings.sparkSession.createDataFrame(list(weights.items()), "level string, weight double")
    return findings.groupBy("level").agg(F.count("*").alias("n")).join(F.broadcast(w), "level").select("level", "n", "weight", (F.col("n") * F.col("weight")).alias("cost"))


def competency_coverage(session, questions: list[dict]) -> DataFrame:
    """name, rows (min_rows at most), satisfied, weight, cost of questions: query, min_rows, weight, contexts."""
    out = []
    for q in questions:
        need = q.get("min_rows", 1)
        n = session.query(q["query"], contexts=tuple(q.get("contexts", ())), limit=need).agg(F.count("*").alias("rows"))
        out.append(n.select(F.lit(q["name"]).alias("name"), "rows", (F.col("rows") >= need).alias("satisfied"), F.lit(float(q.get("weight", 1.0))).alias("weight")))
    return reduce(DataFrame.unionByName, out).withColumn("cost", F.when(F.col("satisfied"), 0.0).otherwise(F.col("weight")))


def competency_questions(meta, limit: int | None = None) -> list[dict]:
    """Questions that a schema suggests: is there anything of each type, and of each relation."""
    out = [{"name": f"some_{t}", "question": f"Is there any {t}?", "query": f"select ?x where ?x : {t}", "min_rows": 1, "weight": 1.0} for t in sorted(meta.types)]
    for (_, r), fields in sorted(meta.relations.items()):
        out.append({"name": f"some_{r}", "question": f"Is any {r} stated?", "query": f"select ?f where ?f = {r}({', '.join(f'{f}=?v{i}' for i, (f, _) in enumerate(fields))})", "min_rows": 1, "weight": 1.0})
    return out[:limit]


def precision_recall(found: DataFrame, held_out: DataFrame) -> DataFrame:
    """One row (hits, n_found, n_held_out, precision, recall) of two sets of tuples."""
    f, h = found.distinct(), held_out.distinct()
    side = lambda df, n: df.agg(F.count("*").alias(n))
    one = side(f.intersect(h), "hits").crossJoin(side(f, "n_found")).crossJoin(side(h, "n_held_out"))  # one row each
    ratio = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(0.0)
    return one.select("*", ratio("n_found").alias("precision"), ratio("n_held_out").alias("recall"))


def aggregate_facts(facts: DataFrame) -> DataFrame:
    """One row per domain and normalised statement of (position, domain, statement, confidence): noisy-or of confidences."""
    key = F.concat_ws(":", "domain", statement_key(F.col("statement")))
    return facts.groupBy(key.alias("key")).agg(F.min_by("statement", "position").alias("statement"), F.count("*").alias("n"), (1 - F.product(1 - F.col("confidence"))).alias("confidence"))


def merge_proposals(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates by type and normalised name, and attribute conflicts, of (position, type, name, confidence, evidence, attrs map).

    Evidence is united, confidence the greatest; an attribute is the most confident one's,
    the later one's among equals.
    """
    p = proposals.withColumn("name_key", name_key(F.col("name")))
    merged = p.groupBy("type", "name_key").agg(F.min_by("name", "position").alias("name"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.count("*").alias("n"))
    a = p.select("type", "name_key", "position", "confidence", F.explode("attrs").alias("key", "value"))
    values = a.groupBy("type", "name_key", "key").agg(F.max_by("value", F.struct("confidence", "position")).alias("value"), F.countDistinct("value").alias("n_values"))
    attrs = values.groupBy("type", "name_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    return merged.join(attrs, ["type", "name_key"], "left"), values.where("n_values > 1")


def mention_roles(mentions: DataFrame) -> DataFrame:
    """type, name, role, confidence, evidence: roles that mentions suggest, at their greatest confidence."""
    return mentions.groupBy("name", "role").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def calibration_bins(records: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_confidence, accuracy of (confidence, correct)."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return records.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibrated(confidences: DataFrame, table: DataFrame, bins: int = 10) -> DataFrame:
    """confidences with `calibrated`: their bin's accuracy, weighed by min(n / 100, 1) against the confidence itself."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    w = F.least(F.coalesce(F.col("n"), F.lit(0)) / 100.0, F.lit(1.0))
    own = confidences.withColumn("bin", b).join(F.broadcast(table.select("bin", "n", "accuracy")), "bin", "left")  # as many rows as bins
    return own.withColumn("calibrated", w * F.coalesce("accuracy", F.col("confidence")) + (1 - w) * F.col("confidence")).drop("bin", "n", "accuracy")


def platt(records: DataFrame, epochs: int = 100, rate: float = 0.01) -> tuple[float, float]:
    """a, b of sigmoid(a * confidence + b), by gradient steps over the whole table."""
    a, b = 1.0, 0.0
    kept = cut(records.select(F.col("confidence").cast("double").alias("x"), F.col("correct").cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n")))
    for _ in range(epochs):
        e = (1 / (1 + F.exp(-(a * F.col("x") + b))) - F.col("y")) * F.col("n")
        g = kept.agg(F.sum(e * F.col("x")) / F.sum("n"), F.sum(e) / F.sum("n")).first()
        if g[0] is None:
            break
        a, b = a - rate * g[0], b - rate * g[1]
    return a, b


def belief_propagation(variables: DataFrame, unary: DataFrame, pairwise: DataFrame, rounds: int = 20) -> DataFrame:
    """var, belief (that it is true): sum-product over binary variables.

    unary: var, p0, p1; pairwise: factor, a, b, p00, p01, p10, p11. Messages pass along
    both ways of each pairwise factor in every round; exact on trees.
    """
    own = cut(variables.toDF("var").distinct().join(unary.groupBy("var").agg(F.product("p0").alias("u0"), F.product("p1").alias("u1")), "var", "left").select("var", F.coalesce("u0", F.lit(1.0)).alias("u0"), F.coalesce("u1", F.lit(1.0)).alias("u1")))
    forth = pairwise.select("factor", F.col("a").alias("s"), F.col("b").alias("t"), "p00", "p01", "p10", "p11")
    back = pairwise.select("factor", F.col("b").alias("s"), F.col("a").alias("t"), "p00", F.col("p10").alias("p01"), F.col("p01").alias("p10"), "p11")
    f = cut(forth.unionByName(back))
    message = cut(f.select("factor", "s", "t", F.lit(0.5).alias("m0"), F.lit(0.5).alias("m1")))
    for _ in range(rounds):
        got = message.groupBy(F.col("t").alias("s")).agg(F.product("m0").alias("g0"), F.product("m1").alias("g1"))
        turned = message.select("factor", F.col("t").alias("s"), F.col("s").alias("t"), F.col("m0").alias("r0"), F.col("m1").alias("r1"))
        h = f.join(own.withColumnRenamed("var", "s"), "s").join(got, "s").join(turned, ["factor", "s", "t"])
        h = h.withColumns({"h0": F.col("u0") * F.col("g0") / F.col("r0"), "h1": F.col("u1") * F.col("g1") / F.col("r1")})
        new = h.select("factor", "s", "t", (F.col("h0") * F.col("p00") + F.col("h1") * F.col("p10")).alias("x0"), (F.col("h0") * F.col("p01") + F.col("h1") * F.col("p11")).alias("x1"))
        message = cut(new.select("factor", "s", "t", (F.col("x0") / (F.col("x0") + F.col("x1"))).alias("m0"), (F.col("x1") / (F.col("x0") + F.col("x1"))).alias("m1")))
    got = message.groupBy(F.col("t").alias("var")).agg(F.product("m0").alias("g0"), F.product("m1").alias("g1"))
    b = own.join(got, "var", "left").select("var", (F.col("u0") * F.coalesce("g0", F.lit(1.0))).alias("b0"), (F.col("u1") * F.coalesce("g1", F.lit(1.0))).alias("b1"))
    return b.select("var", (F.col("b1") / (F.col("b0") + F.col("b1"))).alias("belief"))


def factors_of_facts(facts: DataFrame, support: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """unary and pairwise factors of (id, confidence, supports array of ids)."""
    unary = facts.select(F.col("id").alias("var"), (1 - F.col("confidence")).alias("p0"), F.col("confidence").alias("p1"))
    pairs = facts.select(F.col("id").alias("a"), F.explode("supports").alias("b"))
    s = F.lit(support)
    return unary, pairs.select(F.concat_ws("-", "a", "b").alias("factor"), "a", "b", s.alias("p00"), (1 - s).alias("p01"), (1 - s).alias("p10"), s.alias("p11"))
