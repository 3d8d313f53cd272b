"""Deletes and key changes followed through all relationships.

Both are fixpoints by rounds. A round takes only what the round before found (the deleted
key values, or the changed keys), follows each relationship from it once, and leaves out
what is known; so chains, diamonds and tables that refer to themselves end by themselves.
Rounds are written to the shared folder; only whether one is empty comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.checkpoints import written
from gridspark.functions.columns import compile_expression, frame_context
from gridspark.plans.tables import bracketed
from gridspark.sources.schema import Relationship

from .constraints import cascade_update


@dataclass
class Cascaded:
    """The tables afterwards, and by relationship the rows that forbid the change: those whose
    parent goes though the relationship is enforced and does not cascade."""

    tables: dict[str, DataFrame]
    blocked: dict[str, DataFrame] = field(default_factory=dict)


def _equal(left: DataFrame, right: DataFrame, columns: list[str], others: list[str], null_safe: bool = False) -> Column:
    pairs = [(left[bracketed(a)], right[bracketed(b)]) for a, b in zip(columns, others, strict=True)]
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def _prefixed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(bracketed(c)).alias(f"__{c}") for c in columns]).distinct()


def delete_through(tables: dict[str, DataFrame], relationships: list[Relationship], table: str, condition: str) -> Cascaded:
    """Deletes the rows of `table` that meet `condition` (in the dialect), and all that depends on them.

    What a relationship reads of a table decides whether a row goes with its parent, so each
    round keeps distinct values of those columns, not rows.
    """
    used = {t: sorted({c for r in relationships for owner, cs in ((r.child, r.child_columns), (r.parent, r.parent_columns)) if owner == t for c in cs}) for t in tables}
    hit = F.coalesce(compile_expression(condition, frame_context(dict(tables[table].dtypes))), F.lit(False))
    deltas = {table: written(tables[table].filter(hit).select(*map(bracketed, used[table])).distinct(), "deleted")} if used[table] else {}
    started = dict(deltas)
    gone: dict[str, DataFrame] = {}
    while deltas:
        found: dict[str, DataFrame] = {}
        for r in relationships:
            if r.parent not in deltas or not r.enforced or not r.cascade_delete:
                continue
            keys = _prefixed(deltas[r.parent], r.parent_columns)
            child = tables[r.child].select(*map(bracketed, used[r.child])).distinct()
            reached = child.join(keys, _equal(child, keys, r.child_columns, [f"__{c}" for c in r.parent_columns]), "left_semi")
            found[r.child] = found[r.child].unionByName(reached) if r.child in found else reached
        deltas = {}
        for name, rows in found.items():
            rows = rows.distinct()
            if name in gone:
                known = gone[name].withColumnsRenamed({c: f"__{c}" for c in used[name]})
                rows = rows.join(known, _equal(rows, known, used[name], [f"__{c}" for c in used[name]], null_safe=True), "left_anti")
            rows = written(rows, "deleted")
            if not rows.isEmpty():
                deltas[name] = rows
                gone[name] = gone[name].unionByName(rows) if name in gone else rows
    after = {}
    for name, df in tables.items():
        left = df.filter(~hit) if name == table else df
        if name in gone:
            known = gone[name].withColumnsRenamed({c: f"__{c}" for c in used[name]})
            left = left.join(known, _equal(left, known, used[name], [f"__{c}" for c in used[name]], null_safe=True), "left_anti")
        after[name] = left
    blocked = {}
    for r in relationships:
        parents = [x[r.parent] for x in (started, gone) if r.parent in x]
        if r.enforced and not r.cascade_delete and parents:
            keys = _prefixed(reduce(DataFrame.unionByName, parents), r.parent_columns)
            child = after[r.child]
            blocked[r.name] = child.join(keys, _equal(child, keys, r.child_columns, [f"__{c}" for c in r.parent_columns]), "left_semi")
    return Cascaded(after, blocked)


def change_keys(tables: dict[str, DataFrame], relationships: list[Relationship], table: str, values: dict[str, str], condition: str = "True") -> Cascaded:
    """Sets columns of `table` to expressions of the dialect where `condition` holds, and follows changed keys.

    A child's columns change with its parent's key; where they are part of a key of its
    own, that change goes on. More rounds than relationships allow mean a circle of keys: an error.
    """
    context = frame_context(dict(tables[table].dtypes))
    hit = F.coalesce(compile_expression(condition, context), F.lit(False))
    kinds = dict(tables[table].dtypes)
    old = {f"__old_{c}": F.col(bracketed(c)) for c in tables[table].columns}
    new = {c: F.when(hit, compile_expression(e, context).cast(kinds[c])).otherwise(F.col(bracketed(c))) for c, e in values.items()}
    now = dict(tables)
    pending = [(table, tables[table].withColumns(old).withColumns(new))]
    blocked: dict[str, DataFrame] = {}
    for _ in range(len(relationships) + 2):
        if not pending:
            return Cascaded(now, blocked)
        following: dict[str, DataFrame] = {}
        for name, both in pending:
            both = written(both, "changed")
            now[name] = both.select(*[bracketed(c) for c in both.columns if not c.startswith("__old_")])
            for r in relationships:
                if r.parent != name or not r.enforced:
                    continue
                sides = [F.struct(*[F.col(bracketed(p + c)).alias(f"k{i}") for i, c in enumerate(r.parent_columns)]) for p in ("__old_", "")]
                changes = both.select(sides[0].alias("old"), sides[1].alias("new")).filter(~F.col("old").eqNullSafe(F.col("new"))).distinct()
                if changes.isEmpty():
                    continue
                base = following.get(r.child)
                child = base if base is not None else now[r.child].withColumns({f"__old_{c}": F.col(bracketed(c)) for c in now[r.child].columns})
                if r.cascade_update:
                    following[r.child] = cascade_update(child, changes, r)
                else:
                    keys = changes.select(*[F.col(f"old.k{i}").alias(f"__{c}") for i, c in enumerate(r.parent_columns)])
                    blocked[r.name] = now[r.child].join(keys, _equal(now[r.child], keys, r.child_columns, [f"__{c}" for c in r.parent_columns]), "left_semi")
        pending = list(following.items())
    raise ValueError(f"the keys behind {table} change in a circle")
