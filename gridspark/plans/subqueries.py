"""Subqueries inside expressions, as joins.

A conjunct of WHERE that asks whether a row is matched becomes a semi or anti join. Any
other subquery gives each row a value: it is evaluated once for the distinct values that
it takes from outside, and joined back by them. IN, ANY and ALL follow SQL's three
values: beside the match they need whether there are rows at all, and whether nulls are
among them. Names are looked up inside the subquery first, then outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import Compiler, Context
from gridspark.functions.grammar import SUBQUERIES, Node, parse, walk
from gridspark.functions.registry import AGGREGATES

from .clauses import fail, read_select, unions
from .tables import Tables

Path = tuple[str, ...]


def conjuncts(tree: Node) -> list[Node]:
    """The operands of a chain of And."""
    if tree.kind == "group":
        return conjuncts(tree.children[0])
    if tree.kind == "binary" and tree.value == "and":
        return [c for side in tree.children for c in conjuncts(side)]
    return [tree]


def has_subquery(tree: Node) -> bool:
    return any(n.kind in SUBQUERIES for n in walk(tree))


def has_aggregate(tree: Node) -> bool:
    return any(n.kind == "call" and n.path[-1].lower() in AGGREGATES for n in walk(tree))


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class _Inner:
    """One SELECT inside an expression: its model, its tables, and the names that it takes from outside."""

    def __init__(self, sql: str, tables: Tables, context: Context):
        from .execute import joined_sources
        from .stored import select

        self.model, inner = read_select(sql)
        nested = {name.casefold(): text for name, text in inner.items()}
        self.tables: Tables = lambda name: select(nested[name.casefold()], tables, context.params) if name.casefold() in nested else tables(name)
        self.df, self.context = joined_sources(self.model, self.tables, context.params, null_concat=context.null_concat)
        self.where = conjuncts(parse(self.model.where)) if self.model.where else []
        self.column = parse(self.model.columns[0].expression) if self.model.columns else None
        self.having = parse(self.model.having) if self.model.having else None
        self.groups = [parse(g.expression) for g in self.model.groups]
        self.grouped = bool(self.groups) or any(has_aggregate(t) for t in (self.column, self.having) if t is not None)

    def trees(self) -> list[Node]:
        return [t for t in (*self.where, self.column, self.having, *self.groups) if t is not None]

    def value(self) -> Node:
        """The one column that is selected."""
        if len(self.model.columns) != 1 or self.column is None or self.column.kind == "star":
            if not self.model.columns and len(self.df.columns) == 1:
                return Node("name", self.df.columns[0], path=(self.df.columns[0],))
            raise fail("a subquery of several columns")
        return self.column


def _free(sql: str, tables: Tables, context: Context) -> list[Path]:
    """Names in a subquery that none of its own tables has."""
    out: dict[Path, None] = {}
    for part, _ in unions(sql):
        inner = _Inner(part, tables, context)
        for tree in inner.trees():
            for n in walk(tree):
                paths = [n.path] if n.kind in ("name", "member") else _free(n.value, inner.tables, context) if n.kind in SUBQUERIES else []
                out |= {p: None for p in paths if inner.context.resolve(p) is None}
    return list(out)


def _outside(sql: str, tables: Tables, context: Context) -> list[Path]:
    """The names that a subquery takes from the query around it."""
    return [p for p in _free(sql, tables, context) if context.resolve(p) is not None]


def _matched(inner: _Inner, name: str, keys: dict[Path, Column], tables: Tables, context: Context, first: DataFrame) -> tuple[DataFrame, Context]:
    """`first(keys)` joined with the subquery's rows that its WHERE admits for them."""
    resolve: Callable[[Path], Column | None] = lambda path: own if (own := inner.context.resolve(path)) is not None else keys.get(path)
    both = replace(inner.context, resolve=resolve, replaced={})
    plain = [c for c in inner.where if not has_subquery(c)]
    if not any(n.path in keys for c in plain for n in walk(c) if inner.context.resolve(n.path or ("",)) is None):
        raise fail("a subquery whose own conditions don't name the query around it")
    df = first.join(inner.df, _both([Compiler(both).column(c) for c in plain]))
    rest = [c for c in inner.where if has_subquery(c)]
    if rest:
        df, _ = attach(df, rest, inner.tables, both, f"{name}_")
        df = df.filter(_both([Compiler(both).column(c) for c in rest]))
    return df, both


def _groups(df: DataFrame, inner: _Inner, names: list[str], context: Context) -> tuple[DataFrame, Context, list[str]]:
    """The subquery's groups for each value of the columns `names`; the columns of its counts."""
    measures: dict[Node, str] = {}
    for tree in (inner.value() if inner.model.columns else None, inner.having):
        for n in walk(tree) if tree is not None else ():
            if n.kind == "call" and n.path[-1].lower() in AGGREGATES and n not in measures:
                measures[n] = f"__m{len(measures)}"
    compiler = Compiler(context)
    by = {n: f"__g{i}" for i, n in enumerate(inner.groups)}
    made = [compiler.column(n).alias(a) for n, a in measures.items()]
    keyed = df.groupBy(*names, *[compiler.column(n).alias(a) for n, a in by.items()])
    out = keyed.agg(*made, F.lit(True).alias("__any")) if made else keyed.agg(F.lit(True).alias("__any"))
    return out, replace(context, replaced={**context.replaced, **{n: F.col(a) for n, a in (*by.items(), *measures.items())}}), [a for n, a in measures.items() if n.path[-1].lower() == "count"]


def _rows(node: Node, name: str, tables: Tables, context: Context, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """(names..., y) of the rows that a subquery gives for each value it takes from outside, and those values."""
    from .stored import select

    outside = _outside(node.value, tables, context)
    if not outside:
        rows = select(node.value, tables, context.params)
        if node.kind != "exists" and len(rows.columns) != 1:
            raise fail("a subquery of several columns")
        return rows.toDF(*[f"{name}_y", *[f"{name}_y{i}" for i in range(1, len(rows.columns))]]).select(f"{name}_y"), {}
    if len(unions(node.value)) > 1:
        raise fail("a UNION that names the query around it")
    inner = _Inner(node.value, tables, context)
    if inner.model.top:
        raise fail("TOP in a subquery that names the query around it")
    names = {f"{name}_k{i}": context.resolve(p) for i, p in enumerate(outside)}
    keys = {p: F.col(n) for p, n in zip(outside, names, strict=True)}
    first = df.select(*[c.alias(n) for n, c in names.items()]).distinct()
    found, both = _matched(inner, name, keys, tables, context, first)
    if inner.grouped and not inner.groups and inner.having is None and node.kind == "exists":
        return first.withColumn(f"{name}_y", F.lit(True)), names
    if inner.grouped:
        found, both, counts = _groups(found, inner, list(names), both)
        if not inner.groups:  # one row for each value, also where nothing is matched
            found = first.join(found.withColumnsRenamed({n: f"{n}r" for n in names}), _both([F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names]), "left")
            found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        if inner.having is not None:
            found = found.filter(Compiler(both).column(inner.having))
    y = F.lit(True) if node.kind == "exists" else Compiler(both).column(inner.value())
    return found.select(*names, y.alias(f"{name}_y")), names


def _joined(df: DataFrame, made: DataFrame, names: dict[str, Column], more: Column | None = None) -> DataFrame:
    """`df` with what was made for its values of `names`: one row of it at most, where `more` holds."""
    on = [c.eqNullSafe(F.col(f"{n}_")) for n, c in names.items()] + ([more] if more is not None else [])
    made = made.withColumnsRenamed({n: f"{n}_" for n in names})
    return df.join(made, _both(on), "left") if on else df.crossJoin(F.broadcast(made))  # one row


_FLIP = {"<": ("max", "min"), "<=": ("max", "min"), ">": ("min", "max"), ">=": ("min", "max")}


def _attach(df: DataFrame, node: Node, name: str, tables: Tables, context: Context) -> tuple[DataFrame, Column]:
    rows, names = _rows(node, name, tables, context, df)
    y, by = F.col(f"{name}_y"), rows.groupBy(*names)
    if node.kind == "exists":
        df = _joined(df, by.agg(F.count(F.lit(1)).alias(f"{name}_n")), names)
        made = F.coalesce(F.col(f"{name}_n"), F.lit(0)) > 0
        return df, ~made if node.negated else made
    if node.kind == "subquery":
        several = F.raise_error(F.lit("at most one record can be returned by a subquery"))
        df = _joined(df, by.agg(F.when(F.count(F.lit(1)) > 1, several.cast(rows.schema[f"{name}_y"].dataType)).otherwise(F.first(y)).alias(f"{name}_v")), names)
        return df, F.col(f"{name}_v")
    x = Compiler(context).column(node.children[0])
    n, nulls, low, high = (F.col(f"{name}_{c}") for c in ("n", "nulls", "min", "max"))
    op, every = (node.path[0], node.path[1] == "all") if node.kind == "quantified" else ("=", False)
    df = _joined(df, by.agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count_if(y.isNull()).alias(f"{name}_nulls"), F.min(y).alias(f"{name}_min"), F.max(y).alias(f"{name}_max")), names)
    if (op, every) in (("=", False), ("<>", True)):
        values = rows.filter(y.isNotNull()).distinct().withColumn(f"{name}_hit", F.lit(True)).withColumnRenamed(f"{name}_y", f"{name}_x")
        if names:
            df = _joined(df, values.withColumnsRenamed({k: f"{k}v" for k in names}), {f"{k}v": c for k, c in names.items()}, x == F.col(f"{name}_x"))
        else:
            df = df.join(values, x == F.col(f"{name}_x"), "left")
        sure = F.col(f"{name}_hit").isNotNull()
        found = F.when(F.coalesce(n, F.lit(0)) == 0, False).when(x.isNull(), F.lit(None)).when(sure, True).when(nulls > 0, F.lit(None)).otherwise(False)
        return df, ~found if node.negated or every else found
    compare = {"<": lambda b: x < b, "<=": lambda b: x <= b, ">": lambda b: x > b, ">=": lambda b: x >= b}
    if op in compare:
        bound = {"min": low, "max": high}[_FLIP[op][every]]
        holds = compare[op](bound)
    else:  # = ALL, <> ANY
        same = (x == low) & (x == high)
        holds = same if every else ~same
    if every:
        return df, F.when(F.coalesce(n, F.lit(0)) == 0, True).when(x.isNull(), F.lit(None)).when(low.isNotNull() & ~holds, False).when(nulls > 0, F.lit(None)).otherwise(True)
    return df, F.when(F.coalesce(n, F.lit(0)) == 0, False).when(x.isNull(), F.lit(None)).when(low.isNotNull() & holds, True).when(nulls > 0, F.lit(None)).otherwise(False)


def _nodes(trees: list[Node]) -> Iterator[Node]:
    """Subqueries, those within the operands of another first."""
    for tree in trees:
        for n in reversed(list(walk(tree))):
            if n.kind in SUBQUERIES:
                yield n


def attach(df: DataFrame, trees: list[Node], tables: Tables, context: Context, prefix: str = "__q") -> tuple[DataFrame, list[str]]:
    """`df` with what the subqueries in `trees` need, in new columns; their values go to `context.replaced`."""
    before = set(df.columns)
    for node in _nodes(trees):
        if node not in context.replaced:
            df, context.replaced[node] = _attach(df, node, f"{prefix}{len(context.replaced)}", tables, context)
    return df, [c for c in df.columns if c not in before]


def _semi(df: DataFrame, node: Node, name: str, tables: Tables, context: Context) -> DataFrame | None:
    """`df` filtered by a conjunct that asks for a match, by one semi or anti join; None where that doesn't do."""
    from .stored import select

    if node.kind not in ("exists", "in_query") or (node.kind == "in_query" and node.negated):
        return None
    how = "left_anti" if node.negated else "left_semi"
    outside = _outside(node.value, tables, context)
    x = None if node.kind == "exists" else Compiler(context).column(node.children[0])
    if not outside:
        if x is None:
            return None
        rows = select(node.value, tables, context.params)
        if len(rows.columns) != 1:
            raise fail("a subquery of several columns")
        return df.join(rows.toDF(f"{name}_y"), x == F.col(f"{name}_y"), how)
    if len(unions(node.value)) > 1:
        return None
    inner = _Inner(node.value, tables, context)
    if inner.grouped or inner.model.top or any(has_subquery(c) for c in inner.where):
        return None
    trees = [*inner.where, *([inner.value()] if x is not None else [])]
    used = {n.path: None for t in trees for n in walk(t) if n.kind in ("name", "member") and inner.context.resolve(n.path) is not None}
    own = {p: f"{name}_c{i}" for i, p in enumerate(used)}  # names of its own: both sides may hold the same table
    resolve: Callable[[Path], Column | None] = lambda path: F.col(own[path]) if path in own else context.resolve(path)
    both = Compiler(replace(context, resolve=resolve, replaced={}))
    on = [both.column(c) for c in inner.where] + ([x == both.column(inner.value())] if x is not None else [])
    return df.join(inner.df.select(*[inner.context.resolve(p).alias(a) for p, a in own.items()]), _both(on), how)


def filtered(df: DataFrame, tree: Node, tables: Tables, context: Context) -> tuple[DataFrame, list[str]]:
    """`df` where `tree` holds, and the columns added on the way."""
    rest = []
    for i, c in enumerate(conjuncts(tree)):
        inner = c.children[0] if c.kind == "unary" and c.value == "not" else None
        while inner is not None and inner.kind == "group":
            inner = inner.children[0]
        if inner is not None and inner.kind == "exists":
            c = replace(inner, negated=not inner.negated)
        done = _semi(df, c, f"__s{i}", tables, context) if c.kind in SUBQUERIES else None
        if done is None:
            rest.append(c)
        else:
            df = done
    df, added = attach(df, rest, tables, context)
    return (df.filter(_both([Compiler(context).column(c) for c in rest])) if rest else df), added


def condition(df: DataFrame, text: str, tables: Tables, context: Context) -> tuple[DataFrame, Column, list[str]]:
    """`df` with what a condition's subqueries need, the condition, and the columns added."""
    tree = parse(text)
    df, added = attach(df, [tree], tables, context)
    return df, Compiler(context).column(tree), added
