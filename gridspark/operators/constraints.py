"""Schema rules as queries: violations, defaults, foreign keys and cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.functions.columns import compile_expression, frame_context
from gridspark.plans.tables import bracketed
from gridspark.sources.schema import Relationship, TableModel, with_subject


def check_violations(df: DataFrame, column: str, rule: str) -> DataFrame:
    """Rows that break a validation rule; a rule that is null for a row is kept, as CHECK does."""
    return df.filter(~compile_expression(with_subject(rule, column), frame_context(dict(df.dtypes))))


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows (`copies`)."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def missing_values(df: DataFrame, column: str, allow_zero_length: bool = True) -> DataFrame:
    """Rows where a required column is null, or empty where that is not allowed."""
    value = F.col(bracketed(column))
    return df.filter(value.isNull() if allow_zero_length else value.isNull() | (value == ""))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """New rows with default expressions in place of nulls."""
    context = frame_context(dict(df.dtypes))
    return df.withColumns({c: F.coalesce(F.col(bracketed(c)), compile_expression(e, context).cast(dict(df.dtypes)[c])) for c, e in defaults.items()})


def table_violations(df: DataFrame, table: TableModel) -> DataFrame:
    """(constraint, detail, rows) of every rule of a table model that has violations."""
    context = frame_context(dict(df.dtypes))
    tests: list[tuple[str, str, Column]] = []
    for c in table.columns:
        if c.name not in df.columns:
            continue
        value = F.col(bracketed(c.name))
        if not c.nullable or c.required:
            tests.append(("not_null", c.name, value.isNull()))
        if not c.allow_zero_length:
            tests.append(("zero_length", c.name, value == ""))
        if c.rule:
            tests.append(("check", c.name, ~compile_expression(with_subject(c.rule, c.name), context)))
    if not tests:
        return df.sparkSession.createDataFrame([], "constraint string, detail string, rows long")
    counts = df.agg(*[F.count_if(t).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)])  # one pass for all rules
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("constraint"), F.lit(d).alias("detail"), F.col(f"t{i}").alias("rows")) for i, (k, d, _) in enumerate(tests)]))
    return counts.select(rows.alias("r")).select("r.*").filter("rows > 0")


def _on(child: DataFrame, parent: DataFrame, child_columns: list[str], parent_columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [child[c] == parent[p] for c, p in zip(child_columns, parent_columns, strict=True)])


def orphans(child: DataFrame, parent: DataFrame, relationship: Relationship) -> DataFrame:
    """Child rows whose whole key is set and has no parent; none for a relationship that is not enforced."""
    if not relationship.enforced:
        return child.limit(0)
    keyed = child.filter(reduce(lambda a, b: a & b, [child[c].isNotNull() for c in relationship.child_columns]))
    return keyed.join(parent, _on(keyed, parent, relationship.child_columns, relationship.parent_columns), "left_anti")


def join_parent(child: DataFrame, parent: DataFrame, relationship: Relationship, kind: str = "inner") -> DataFrame:
    return child.join(parent, _on(child, parent, relationship.child_columns, relationship.parent_columns), kind)


def cascade_delete(child: DataFrame, deleted: DataFrame, relationship: Relationship) -> DataFrame:
    """Child rows that stay when parent rows go: all of them without the cascade."""
    if not relationship.cascade_delete:
        return child
    return child.join(deleted, _on(child, deleted, relationship.child_columns, relationship.parent_columns), "left_anti")


def cascade_update(child: DataFrame, changes: DataFrame, relationship: Relationship) -> DataFrame:
    """Child rows after key changes `changes(old, new)`: values, or structs of the key's columns in their order."""
    if not relationship.cascade_update:
        return child
    columns, kind = relationship.child_columns, changes.schema["old"].dataType
    parts = [f"old.{f.name}" for f in kind.fields] if isinstance(kind, StructType) else ["old"]
    if len(parts) != len(columns):
        raise ValueError(f"the key of {relationship.name} has {len(columns)} columns, the changes have {len(parts)}")
    news = [F.col(p.replace("old", "new", 1)).alias(f"new_{i}") for i, p in enumerate(parts)] if len(parts) == 1 else [F.col(f"new.{f.name}").alias(f"new_{i}") for i, f in enumerate(changes.schema["new"].dataType.fields)]
    moved = changes.select(*[F.col(p).alias(f"old_{i}") for i, p in enumerate(parts)], *news, F.lit(True).alias("moved"))
    on = reduce(lambda a, b: a & b, [child[c] == moved[f"old_{i}"] for i, c in enumerate(columns)])
    joined = child.join(moved, on, "left")
    place = {c: i for i, c in enumerate(columns)}
    return joined.select(*[(F.when(F.col("moved"), F.col(f"new_{place[c]}")).otherwise(child[c]) if c in place else child[c]).alias(c) for c in child.columns])


def with_lookup(df: DataFrame, column: str, source: DataFrame, bound: str, shown: str, alias: str) -> DataFrame:
    """A lookup column: the shown value of the row source's row whose bound column is the stored value.

    Where several rows have that bound value the least shown one counts, so rows do not multiply.
    """
    values = source.groupBy(F.col(bracketed(bound)).alias("__bound")).agg(F.min(bracketed(shown)).alias(alias))
    return df.join(values, df[column] == F.col("__bound"), "left").drop("__bound")
