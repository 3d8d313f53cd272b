"""Domain aggregates over a range that ends at each row's value, without comparing row by row.

Domain rows and the distinct values sought are laid in one order and dealt by ranges of it.
A window sums up each range, the ranges' own totals (a row for each range and group) are
summed up in turn, and what a value is after is its range's sum so far plus what came before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.checkpoints import written
from gridspark.functions.columns import Compiler, Context
from gridspark.functions.grammar import Node, walk

from .subqueries import conjuncts

RUNNING = frozenset({"sum", "count", "avg", "min", "max"})
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}

Split = tuple[list[Node], list[tuple[Node, Node]], tuple[str, Node, Node]]


def split_criteria(tree: Node, values: list[str]) -> Split | None:
    """(conditions of the domain alone, its (expression, value) pairs of equality, (operator, expression, value) of its
    one range) of criteria over a domain and the names `values`; None for criteria of another shape."""
    names = lambda n: {m.path[-1] for m in walk(n) if m.kind in ("name", "member")}
    own, equal, ranges = [], [], []
    for c in conjuncts(tree):
        if not names(c) & set(values):
            own.append(c)
            continue
        if c.kind != "binary" or c.value not in _MIRROR:
            return None
        (left, right), op = c.children, c.value
        if names(left) <= set(values) and names(left):
            left, right, op = right, left, _MIRROR[op]
        if names(left) & set(values) or not names(right) <= set(values):
            return None
        (equal.append((left, right)) if op == "=" else ranges.append((op, left, right)))
    return (own, equal, ranges[0]) if len(ranges) == 1 else None


def running_values(keys: DataFrame, domain: DataFrame, split: Split, value: Column, kind: str, names: list[str], inner: Context, both: Context) -> DataFrame:
    """(names..., value) of the aggregate `kind` over the domain rows that the criteria admit for each row of `keys`.

    Values with a null, which no row equals or is less than, have no row in the result.
    """
    own, equal, (op, expression, sought) = split
    for c in own:
        domain = domain.filter(Compiler(inner).column(c))
    groups = [f"__g{i}" for i in range(len(equal))]
    made = [Compiler(inner).column(e).alias(g) for (e, _), g in zip(equal, groups, strict=True)]
    rows = domain.select(*made, Compiler(inner).column(expression).alias("__at"), value.alias("__x"))
    wanted = keys.select(*names, *[Compiler(both).column(v).alias(g) for (_, v), g in zip(equal, groups, strict=True)], Compiler(both).column(sought).alias("__at"))
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*groups, "__at")])
    # at equal places the domain's rows come first if they count, else last
    domain_first = op in ("<=", ">=")
    laid = rows.filter(there).withColumn("__side", F.lit(0 if domain_first else 1)).unionByName(wanted.filter(there).withColumn("__side", F.lit(1 if domain_first else 0)), allowMissingColumns=True)
    is_key = F.col("__side") == (1 if domain_first else 0)
    at = F.col("__at").asc() if op in ("<", "<=") else F.col("__at").desc()
    order = [*groups, at, "__side"]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(laid.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "running").withColumn("__part", F.shiftright("__id", 33))

    counted = F.when(~is_key, F.lit(1)) if kind == "count" else F.col("__x")
    sums = {"__n": F.count(counted), "__s": F.sum("__x") if kind in ("sum", "avg") else None, "__low": F.min("__x") if kind == "min" else None, "__high": F.max("__x") if kind == "max" else None}
    sums = {k: c for k, c in sums.items() if c is not None}
    again = {"__n": F.sum("__n"), "__s": F.sum("__s"), "__low": F.min("__low"), "__high": F.max("__high")}
    here = Window.partitionBy("__part", *groups).orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = dealt.select("*", *[c.over(here).alias(k) for k, c in sums.items()]).filter(is_key)
    totals = dealt.groupBy("__part", *groups).agg(*[c.alias(k) for k, c in sums.items()])
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__part", *groups, *[again[k].over(before).alias(f"{k}0") for k in sums])
    out = so_far.join(carried, ["__part", *groups])
    n = F.col("__n") + F.coalesce("__n0", F.lit(0))
    plus = F.coalesce(F.col("__s") + F.col("__s0"), "__s", "__s0") if "__s" in sums else None
    result = {"count": lambda: n, "sum": lambda: plus, "avg": lambda: plus / n, "min": lambda: F.least("__low", "__low0"), "max": lambda: F.greatest("__high", "__high0")}[kind]()
    return out.select(*names, result.alias("__value"))
