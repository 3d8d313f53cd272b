"""Coverage of units by stage and status, verdicts, reason codes and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.registry import ADVISORY, ASPECT_OF

#: The stages and statuses of a unit.
STAGES = ("discovery", "extraction", "translation")
STATUSES = ("complete", "partial", "unsupported", "failed", "not_started", "not_applicable")


def percentage(complete: Column, eligible: Column) -> Column:
    return F.when(eligible > 0, F.round(F.try_divide(complete, eligible) * 100, 2)).otherwise(0.0)


def _counted(grouped) -> DataFrame:
    w = F.coalesce(F.col("weight"), F.lit(0))
    of = lambda s: F.sum(F.when(F.col("status") == s, w).otherwise(0)).alias(s)
    out = grouped.agg(F.sum(w).alias("units"), *map(of, STATUSES))
    return out.withColumn("eligible", F.col("units") - F.col("not_applicable")).withColumn("completion_percentage", percentage(F.col("complete"), F.col("eligible")))


def coverage(units: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """Weights by scope, stage and status of `units(stage, status, weight, ...)`; one pass."""
    return _counted(units.groupBy(*(scopes or []), "stage"))


def coverage_scopes(units: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Coverage at several scopes in one pass: a grouping set for each list of columns, null where not in it."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    keyed = [[F.col(c) for c in (*s, "stage")] for s in sets]
    return _counted(units.groupingSets(keyed, *columns, "stage"))


def reason_weights(units: DataFrame) -> DataFrame:
    """(stage, reason_code, weight) of units with a reason."""
    return units.filter(F.col("reason_code").isNotNull()).groupBy("stage", "reason_code").agg(F.sum("weight").alias("weight"))


def reason_index(findings: DataFrame, examples: int = 8) -> DataFrame:
    """(reason_code, objects, examples) of `findings(ordinal, object, reason_code)`: the number of objects
    and the first few, in the order of `ordinal`. Only that many examples leave a task."""
    first = findings.groupBy("reason_code", "object").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("reason_code").orderBy("ordinal", "object"))
    counts = first.groupBy("reason_code").agg(F.count(F.lit(1)).alias("objects"))
    shown = first.withColumn("__n", place).filter(F.col("__n") <= examples).groupBy("reason_code").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "object"))), lambda x: x["object"]).alias("examples"))
    return counts.join(shown, "reason_code").select("reason_code", "objects", "examples")


def aspect_column(code: str = "reason_code") -> Column:
    table = F.create_map(*[F.lit(x) for kv in sorted(ASPECT_OF.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(code)), F.lit("unclassified"))


def blocking(code: str = "reason_code") -> Column:
    return ~F.col(code).isin(*sorted(ADVISORY))


def verdicts(objects: DataFrame, findings: DataFrame) -> DataFrame:
    """(object, aspect, status) of each object and aspect that `objects(object, aspect, has_content)` says it has:
    complete, partial where blocking findings stand beside content, failed where they stand alone."""
    bad = findings.filter(blocking()).select(F.col("object").alias("__o"), aspect_column().alias("__a")).distinct()
    joined = objects.join(bad, (F.col("object") == F.col("__o")) & (F.col("aspect") == F.col("__a")), "left")
    status = F.when(F.col("__o").isNull(), "complete").when(F.col("has_content"), "partial").otherwise("failed")
    return joined.select("object", "aspect", status.alias("status"))


def aspect_totals(verdict: DataFrame) -> DataFrame:
    """Objects by aspect and status, with `scored` and the completion percentage."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = verdict.groupBy("aspect").agg(of("complete"), of("partial"), of("failed"))
    return out.withColumn("scored", F.col("complete") + F.col("partial") + F.col("failed")).withColumn("completion_percentage", percentage(F.col("complete"), F.col("scored")))


def _with_feature(objects: DataFrame) -> DataFrame:
    """Adds `feature`: the kind, or kind:subtype."""
    return objects.withColumn("feature", F.when(F.col("subtype").isNull(), F.col("kind")).otherwise(F.concat_ws(":", "kind", "subtype")))


def feature_rollup(objects: DataFrame, codes: DataFrame) -> DataFrame:
    """By feature: objects by status, the share of complete ones, and blocking codes by (-objects, code)."""
    keyed = _with_feature(objects)
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = keyed.groupBy("feature").agg(F.count(F.lit(1)).alias("objects"), *[of(s) for s in STATUSES if s != "not_applicable"])
    counts = counts.withColumn("completion_percentage", percentage(F.col("complete"), F.col("objects")))
    per = codes.filter(blocking()).select("object", "reason_code").distinct().join(keyed.select("object", "feature"), "object").groupBy("feature", "reason_code").agg(F.count(F.lit(1)).alias("n"))
    listed = per.groupBy("feature").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("reason_code").alias("c")))), lambda x: x["c"]), ",").alias("blocking_codes"))
    return counts.join(listed, "feature", "left").withColumn("blocking_codes", F.coalesce("blocking_codes", F.lit("")))


def feature_aspects(objects: DataFrame, verdict: DataFrame) -> DataFrame:
    """By feature and aspect of `verdict(object, aspect, status)`: objects by status."""
    of = lambda s: F.count_if(F.col("verdict") == s).alias(s)
    rows = _with_feature(objects).select("object", "feature").join(verdict.select("object", "aspect", F.col("status").alias("verdict")), "object")
    return rows.groupBy("feature", "aspect").agg(of("complete"), of("partial"), of("failed"), of("not_applicable"))


def reconcile(declared: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """`declared(keys, declared)` against `named(keys, weight)`: residual, and whether names exceed the count."""
    total = named.groupBy(*keys).agg(F.sum("weight").alias("named"))
    out = declared.join(total, keys, "full").withColumn("declared", F.coalesce("declared", F.lit(0))).withColumn("named", F.coalesce("named", F.lit(0)))
    return out.withColumn("residual", F.col("declared") - F.col("named")).withColumn("over_named", F.col("residual") < 0)


def census(actions: DataFrame) -> DataFrame:
    """(category, actions): sorted distinct actions of `actions(category, action)`."""
    return actions.groupBy("category").agg(F.array_join(F.sort_array(F.collect_set("action")), ",").alias("actions"))


def procedure_metrics(statements: DataFrame) -> DataFrame:
    """Metrics by procedure of `statements(proc, type, arms)`; every arm counts as a branch."""
    of = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    branches = F.sum(F.when(F.col("type").isin("if", "select_case"), F.col("arms")).otherwise(0))
    loops = of("for", "for_each", "while", "do_loop")
    return statements.groupBy("proc").agg(F.count(F.lit(1)).alias("statements"), branches.alias("branches"), loops.alias("loops"), of("exit").alias("exits"), of("goto").alias("gotos"), of("label").alias("labels"), (branches + loops + 1).alias("cyclomatic_complexity"))
