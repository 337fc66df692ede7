"""Constraints on fact tables, typing, and quality reports; a check is a table of violations, empty if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut
from graphloom.snapshot import Constraint, Graph, Meta

VIOLATION = "level string, code string, message string, schema string, relation string, entity_id bigint"


def key_violations(facts: DataFrame, key: list[str]) -> DataFrame:
    """Key values that stand more than once, and how often; repeated rows count, as tuples of a module do."""
    return facts.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def functional_violations(facts: DataFrame, source: list[str], target: str) -> DataFrame:
    return facts.groupBy(*source).agg(F.countDistinct(target).alias("n")).where("n > 1")


def at_most_violations(facts: DataFrame, source: list[str], target: str, n: int, params: list[str] = ()) -> DataFrame:
    return facts.groupBy(*source, *params).agg(F.countDistinct(target).alias("n")).where(F.col("n") > n)


def symmetric_closure(facts: DataFrame, a: str, b: str, where: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """facts and, with two fields exchanged, those of them that a condition takes; other fields stay."""
    some = facts if where is None else facts.where(F.col(where[0]).isin(list(where[1])))
    turned = some.select(*(F.col(b if c == a else a if c == b else c).alias(c) for c in facts.columns))
    return facts.union(turned).distinct()


def transitive_closure(facts: DataFrame, a: str, b: str, params: list[str] = ()) -> DataFrame:
    """Closure of pairs within each value of the parameters, semi-naively, until nothing is new."""
    names = [a, b, *params]
    base = cut(facts.select(*names).distinct())
    step = base.withColumnRenamed(a, "__mid").withColumnRenamed(b, "__to")
    seen = frontier = base
    while True:
        grown = frontier.withColumnRenamed(b, "__mid").join(step, ["__mid", *params]).select(a, F.col("__to").alias(b), *params).distinct()
        frontier = cut(grown.join(seen, names, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def closure_compatible(closed: DataFrame, constraints: list[Constraint], allowed: set[str]) -> DataFrame:
    """Keys and dependencies that a closure breaks: constraint, n. A key over other fields than the closure has fails closed."""
    spark = closed.sparkSession
    out = [spark.createDataFrame([], "constraint string, n bigint")]
    for c in constraints:
        fields = {*c.fields, *([c.target] if c.kind == "functional" else [])}
        if not fields <= allowed:
            out.append(spark.createDataFrame([(f"{c.kind} {c.relation}{c.fields}: a field that the closure does not have", 1)], "constraint string, n bigint"))
        elif c.kind == "key":
            out.append(key_violations(closed, list(c.fields)).select(F.lit(f"key {','.join(c.fields)}").alias("constraint"), "n"))
        else:
            out.append(functional_violations(closed, list(c.fields), c.target).select(F.lit(f"functional {','.join(c.fields)}->{c.target}").alias("constraint"), "n"))
    return reduce(DataFrame.unionByName, out)


def _number(name: Column) -> Column:
    """The number at the end of an element's name, such as 4 of Nat4."""
    return F.try_to_number(F.regexp_extract(name, r"(\d+)$", 1), F.lit("999999999")).cast("bigint")


def typing_violations(rule: str, relations: dict[str, DataFrame], relation: str) -> DataFrame:
    """Typing rules of forms: the output's degree and manifold against the inputs'. Columns: output, problem.

    rule: preserves_manifold_and_increments_degree (k + 1), adds_degrees (k1 + k2, both on
    one manifold) or depends_on_metric_and_dualizes_degree (n - k). What the inputs lack is
    an error; what the output lacks can be derived; what contradicts is an error.
    """
    on, deg = relations["FormOn"].select("form", "manifold"), relations["FormDegree"].select("form", _number(F.col("degree")).alias("k"))
    r = relations[relation]
    look = lambda df, c, n: df.join(on.toDF(c, f"m{n}"), c, "left").join(deg.toDF(c, f"k{n}"), c, "left")
    if rule == "depends_on_metric_and_dualizes_degree":
        dim = relations["ManifoldDimension"].select("manifold", _number(F.col("dim")).alias("n"))
        df = look(r, "input", "1").join(relations["MetricOn"].select("metric", F.col("manifold").alias("mm")), "metric", "left").join(dim.toDF("m1", "n"), "m1", "left")
        want, missing, clash = F.col("n") - F.col("k1"), F.col("m1").isNull() | F.col("k1").isNull() | F.col("mm").isNull() | F.col("n").isNull(), F.col("m1") != F.col("mm")
    elif rule == "adds_degrees":
        names = [c for c in r.columns if c not in ("output", "fact_id")][:2]
        df = look(look(r, names[0], "1"), names[1], "2")
        want, missing, clash = F.col("k1") + F.col("k2"), F.col("m1").isNull() | F.col("m2").isNull() | F.col("k1").isNull() | F.col("k2").isNull(), F.col("m1") != F.col("m2")
    elif rule == "preserves_manifold_and_increments_degree":
        df = look(r, "input", "1")
        want, missing, clash = F.col("k1") + 1, F.col("m1").isNull() | F.col("k1").isNull(), F.lit(False)
    else:
        raise ValueError(f"unknown typing rule {rule}")
    df = df.withColumn("want", want).join(on.toDF("output", "mo"), "output", "left").join(deg.toDF("output", "ko"), "output", "left")
    problem = F.when(missing, "an input is not described").when(clash, "the inputs lie on different manifolds").when(F.col("mo") != F.col("m1"), "the output lies on another manifold").when(F.col("ko") != F.col("want"), "the output has another degree")
    return df.select("output", problem.alias("problem")).where("problem is not null")


def check_constraints(facts: dict[str, DataFrame], constraints: tuple[Constraint, ...]) -> DataFrame:
    """constraint, n of everything that is broken; what is not understood fails closed."""
    spark = next(iter(facts.values())).sparkSession
    note = lambda text: spark.createDataFrame([(text, 1)], "constraint string, n bigint")
    out = [spark.createDataFrame([], "constraint string, n bigint")]
    for c in constraints:
        if c.kind == "unknown":
            out.append(note(f"not understood: {c.text}"))
            continue
        if c.relation not in facts:
            continue  # nothing is stated of it
        f = facts[c.relation]
        f = f.drop("fact_id") if "fact_id" in f.columns else f
        others = [k for k in constraints if k.relation == c.relation and k.kind in ("key", "functional")]
        named = lambda df: df.select(F.lit(c.text or f"{c.kind} {c.relation}").alias("constraint"), "n")  # noqa: B023, E731
        if c.kind == "key":
            out.append(named(key_violations(f, list(c.fields))))
        elif c.kind == "functional":
            out.append(named(functional_violations(f, list(c.fields), c.target)))
        elif c.kind == "at_most":
            out.append(named(at_most_violations(f, list(c.fields), c.target, c.n, list(c.params))))
        elif c.kind == "symmetric":
            a, b = c.fields or tuple(f.columns[:2])
            out.append(closure_compatible(symmetric_closure(f, a, b, c.where), others, set(f.columns)))
        elif c.kind == "transitive":
            if others:
                a, b = c.fields or tuple(f.columns[:2])
                out.append(closure_compatible(transitive_closure(f, a, b, list(c.params)), others, {a, b, *c.params}))
        elif c.kind == "typing":
            out.append(typing_violations(c.target, facts, c.relation).select(F.concat(F.lit(f"typing {c.relation}: "), "problem").alias("constraint"), F.lit(1).cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, out)


def fact_type_violations(graph: Graph) -> DataFrame:
    """Fields of facts whose values have no type that the declaration allows: fact_id, relation, field, value."""
    out = [graph.spark.createDataFrame([], "fact_id bigint, relation string, field string, value bigint")]
    for (_, rel), fields in graph.meta.relations.items():
        if rel not in graph.wide:
            continue
        for f, kind in fields:
            if f not in graph.wide[rel].columns or kind not in graph.meta.types:
                continue
            own = graph.wide[rel].select("fact_id", F.lit(rel).alias("relation"), F.lit(f).alias("field"), F.col(f).cast("bigint").alias("value")).where("value is not null")
            out.append(own.join(graph.type_scan(kind).toDF("value"), "value", "left_anti").select("fact_id", "relation", "field", "value"))
    return reduce(DataFrame.unionByName, out)


def subtype_cycles(meta: Meta) -> list[str]:
    """Types that are their own proper subtypes."""
    out = []
    for t in sorted({x for pair in meta.subtypes for x in pair}):
        seen, todo = set(), [t]
        while todo:
            at = todo.pop()
            for sub, sup in meta.subtypes:
                if sup == at and sub not in seen:
                    seen.add(sub)
                    todo.append(sub)
        if t in seen:
            out.append(t)
    return out


def quality_report(graph: Graph, profile: str = "fast", plane: str = "both", proposals: DataFrame | None = None) -> DataFrame:
    """level, code, message, schema, relation, entity_id of every finding.

    plane: data, meta or both. The strict profile also asks whether facts have a context.
    proposals, if given, are linted too: id, confidence, evidence (array of chunk ids).
    """
    spark = graph.spark
    row = lambda df, level, code, message, rel=None, ident=None: df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), F.lit(None).cast("string").alias("schema"), (rel if isinstance(rel, Column) else F.lit(rel).cast("string")).alias("relation"), (F.col(ident).cast("bigint") if ident else F.lit(None).cast("bigint")).alias("entity_id"))
    out = [spark.createDataFrame([], VIOLATION)]
    if plane in ("meta", "both"):
        out += [spark.createDataFrame([("error", "subtyping_cycle", f"{t} is a subtype of itself", None, None, None)], VIOLATION) for t in subtype_cycles(graph.meta)]
        named = {r for _, r in graph.meta.relations}
        out += [spark.createDataFrame([("warning", "constraint_unknown_relation", f"no relation {c.relation}", None, c.relation, None)], VIOLATION) for c in graph.meta.constraints if c.relation not in named]
        out += [spark.createDataFrame([("warning", "constraint_not_understood", c.text, None, c.relation, None)], VIOLATION) for c in graph.meta.constraints if c.kind == "unknown"]
    if plane in ("data", "both"):
        ids = graph.entities.select("id").unionByName(graph.facts.select(F.col("fact_id").alias("id"))).distinct()
        for end in ("src", "dst"):
            lost = graph.edges.join(ids.toDF(end), end, "left_anti")
            out.append(row(lost, "error", "dangling_source" if end == "src" else "dangling_target", F.concat(F.lit("edge "), F.col("edge_id").cast("string")), F.col("rel"), end))
        for c in graph.meta.constraints:
            if c.relation not in graph.wide:
                continue
            w = graph.wide[c.relation]
            if c.kind == "key":
                bad = key_violations(w, list(c.fields)).select(F.concat_ws(",", *(F.col(x).cast("string") for x in c.fields)).alias("m"))
                out.append(row(bad, "error", "key_violation", F.col("m"), c.relation))
            elif c.kind == "functional":
                bad = functional_violations(w, list(c.fields), c.target).select(F.concat_ws(",", *(F.col(x).cast("string") for x in c.fields)).alias("m"))
                out.append(row(bad, "error", "functional_violation", F.col("m"), c.relation))
            elif c.kind == "at_most":
                bad = at_most_violations(w, list(c.fields), c.target, c.n, list(c.params)).select(F.concat_ws(",", *(F.col(x).cast("string") for x in c.fields)).alias("m"))
                out.append(row(bad, "error", "at_most_violation", F.col("m"), c.relation))
        out.append(row(fact_type_violations(graph), "error", "fact_field_type", F.concat_ws(" ", "field", F.col("value").cast("string")), F.col("relation"), "fact_id"))
        contexts = graph.fact_context.select(F.col("ctx_id").alias("id")).distinct().join(graph.types.where(F.col("type").isin(graph.meta.subtypes_of("Context") + graph.meta.subtypes_of("World"))).select("id"), "id", "left_anti")
        out.append(row(contexts, "warning", "context_target_type", "a context of another type", None, "id"))
        if profile == "strict":
            bare = graph.facts.join(graph.fact_context.select("fact_id").distinct(), "fact_id", "left_anti")
            out.append(row(bare, "info", "context_scoping_coverage", "a fact without a context", F.col("relation"), "fact_id"))
        if proposals is not None:
            out.append(row(proposals.where("proposal_id is null or proposal_id = ''"), "error", "proposal_missing_id", "a proposal without an id"))
            out.append(row(proposals.where("confidence is null"), "warning", "proposal_missing_confidence", F.coalesce("proposal_id", F.lit(""))))
            out.append(row(proposals.where("not coalesce(confidence between 0 and 1, true)"), "error", "proposal_confidence_range", F.coalesce("proposal_id", F.lit(""))))
            out.append(row(proposals.where("coalesce(size(evidence), 0) <= 0"), "warning", "proposal_missing_evidence", F.coalesce("proposal_id", F.lit(""))))
    return reduce(DataFrame.unionByName, out)


def value_violations(graph: Graph, key: str, equals: str | None = None, above: float | None = None, below: float | None = None, between: tuple[float, float] | None = None, one_of: list[str] | None = None) -> DataFrame:
    """id, value of the entities whose attribute is not as wanted; what is no number fails every comparison."""
    v, n = F.col("value"), F.expr("try_cast(value as double)")
    ok = F.lit(True)
    if equals is not None:
        ok = ok & (v == equals)
    if above is not None:
        ok = ok & (n > above)
    if below is not None:
        ok = ok & (n < below)
    if between is not None:
        ok = ok & n.between(*between)
    if one_of is not None:
        ok = ok & v.isin(one_of)
    return graph.attrs.where((F.col("key") == key) & ~F.coalesce(ok, F.lit(False))).select("id", "value")


def quality_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings that a change brings or resolves."""
    return after.exceptAll(before).withColumn("change", F.lit("new")).unionByName(before.exceptAll(after).withColumn("change", F.lit("resolved")))


def checked_append(graph: Graph, relation: str, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """A graph with typed facts appended if nothing is wrong with them; and what is."""
    from dataclasses import replace

    names = [f for (_, r), fs in graph.meta.relations.items() if r == relation for f, _ in fs]
    if set(rows.columns) != {"fact_id", *names}:
        raise ValueError(f"{relation} takes exactly {names}")
    schema = next(s for s, r in graph.meta.relations if r == relation)
    extra = rows.select("fact_id", F.lit(schema).alias("schema"), F.lit(relation).alias("relation"))
    new = replace(graph, wide={**graph.wide, relation: rows.select("fact_id", *names)}, facts=extra)
    bad = fact_type_violations(new)
    if not bad.isEmpty():
        return graph, bad
    merged = graph.wide[relation].unionByName(rows.select(*graph.wide[relation].columns)).dropDuplicates(["fact_id"])
    return replace(graph, wide={**graph.wide, relation: merged}, facts=graph.facts.unionByName(extra).dropDuplicates(["fact_id"])), bad


def guardrail_findings(graph: Graph, rules: list[dict]) -> DataFrame:
    """rule, id of the entities that fail one; each rule stops at its first failing part: required, forbidden, path."""
    out = [graph.spark.createDataFrame([], "rule string, id bigint, part string")]
    for r in rules:
        left = graph.type_scan(r["type"])
        for rel in r.get("required", ()):
            has = graph.edges_of([rel]).select(F.col("src").alias("id")).distinct()
            out.append(left.join(has, "id", "left_anti").select(F.lit(r["name"]).alias("rule"), "id", F.lit("required").alias("part")))
            left = left.join(has, "id", "left_semi")
        for rel in r.get("forbidden", ()):
            has = graph.edges_of([rel]).select(F.col("src").alias("id")).distinct()
            out.append(left.join(has, "id", "left_semi").select(F.lit(r["name"]).alias("rule"), "id", F.lit("forbidden").alias("part")))
            left = left.join(has, "id", "left_anti")
        for path in r.get("paths", ()):
            from graphloom.plans import rpq
            from graphloom.plans.parse_native import parse_regex

            has = rpq.pairs(graph, parse_regex(path), left).select(F.col("src").alias("id")).distinct()
            out.append(left.join(has, "id", "left_anti").select(F.lit(r["name"]).alias("rule"), "id", F.lit("path").alias("part")))
            left = left.join(has, "id", "left_semi")
    return reduce(DataFrame.unionByName, out)
