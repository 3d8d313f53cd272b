"""Query models as DataFrames.

A model becomes one declarative plan: a left-deep fold of joins, filter, grouping,
projection, ordering and limit. Catalyst prunes columns, pushes filters and picks
join strategies; nothing is collected here.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.checkpoints import written
from gridspark.functions.columns import CompileError, Compiler, Context, aggregate, compile_expression, frame_context
from gridspark.functions.grammar import Node, parse, walk
from gridspark.functions.registry import AGGREGATES, DOMAIN

from .model import QueryModel, fold_joins, read_query
from .running import RUNNING, running_values, split_criteria
from .stored import run_stored
from .subqueries import attach, filtered, has_subquery
from .tables import External, Tables, bracketed, parquet_tables  # noqa: F401


class _Frames:
    """The aliased tables of a query and how names find their columns."""

    def __init__(self, frames: dict[str, DataFrame]):
        self.columns = {alias: {c.lower(): (c, t) for c, t in df.dtypes} for alias, df in frames.items()}
        self.by_fold = {alias.casefold(): alias for alias in frames}

    def find(self, path: tuple[str, ...]) -> tuple[str, str, str] | None:
        """(alias, column, type) of a name."""
        if len(path) > 1:
            alias = self.by_fold.get(path[-2].casefold())
            found = self.columns.get(alias, {}).get(path[-1].lower())
            return None if found is None else (alias, *found)
        hits = [(alias, *cols[path[-1].lower()]) for alias, cols in self.columns.items() if path[-1].lower() in cols]
        if len(hits) > 1:
            raise CompileError("EXPRESSION_NODE_NOT_TRANSLATED", f"{path[-1]} is in several tables")
        return hits[0] if hits else None

    def context(self, **options) -> Context:
        def resolve(path: tuple[str, ...]) -> Column | None:
            found = self.find(path)
            return None if found is None else F.col(f"{bracketed(found[0])}.{bracketed(found[1])}")

        def kind(path: tuple[str, ...]) -> str | None:
            found = self.find(path)
            return None if found is None else found[2]

        return Context(resolve, kind=kind, **options)


def _has_aggregate(node: Node) -> bool:
    return any(n.kind == "call" and n.path[-1].lower() in AGGREGATES for n in walk(node))


#: Domain aggregates by the aggregate that each computes.
_DOMAIN = {"dlookup": "first", "dcount": "count", "dsum": "sum", "davg": "avg", "dmin": "min", "dmax": "max", "dfirst": "first", "dlast": "last", "dstdev": "stdev", "dvar": "var"}


def _domain_key(criteria: Node) -> tuple[str, Node] | None:
    """("field", expression) of a criterion that is text ending in = joined to an expression."""
    if criteria.kind == "binary" and criteria.value == "&" and criteria.children[0].kind == "string":
        text = criteria.children[0].value.strip()
        if text.endswith("=") and text[-2:-1] not in ("<", ">"):
            return text[:-1].strip(), criteria.children[1]
    return None


def _attach_domain(df: DataFrame, node: Node, number: int, tables: Tables, context: Context, order: str | None) -> tuple[DataFrame, Column]:
    """Joins the value of a domain aggregate: one row where its criteria are fixed, else by their key."""
    name, args = node.path[-1].lower(), node.children
    if len(args) < 2 or args[0].kind != "string" or args[1].kind != "string":
        raise CompileError("ACCESS_RUNTIME_FUNCTION", f"{name} needs literal names")
    domain = tables(args[1].value.strip("[]"))
    inner = frame_context(dict(domain.dtypes), context.params)
    value = F.lit(1) if args[0].value.strip() == "*" else compile_expression(args[0].value, inner)
    column = f"__domain_{number}"
    made = aggregate(_DOMAIN[name], value, F.col(order) if order and order in domain.columns else None).alias(column)
    key = _domain_key(args[2]) if len(args) > 2 else None
    if key is None:
        if len(args) > 2:
            if args[2].kind != "string":
                return _attach_correlated(df, domain, args[2], made, column, inner, context, _DOMAIN[name], value if args[0].value.strip() != "*" else F.lit(1))
            domain = domain.filter(compile_expression(args[2].value, inner))
        return df.crossJoin(F.broadcast(domain.agg(made))), F.col(column)  # one row
    grouped = domain.groupBy(compile_expression(key[0], inner).alias(f"{column}_key")).agg(made)
    df = df.join(grouped, Compiler(context).column(key[1]) == F.col(f"{column}_key"), "left")
    return df, F.coalesce(F.col(column), F.lit(0)) if name == "dcount" else F.col(column)


def _pieces(criteria: Node) -> list[Node]:
    """The operands of a chain of &."""
    if criteria.kind == "binary" and criteria.value == "&":
        return [p for c in criteria.children for p in _pieces(c)]
    return _pieces(criteria.children[0]) if criteria.kind == "group" else [criteria]


def _attach_correlated(df: DataFrame, domain: DataFrame, criteria: Node, made: Column, column: str, inner: Context, context: Context, kind: str, value: Column) -> tuple[DataFrame, Column]:
    """Joins a domain aggregate whose criteria are text put together from values of the row.

    The text is read with a name in the place of each value (and of the quotes around
    it). The distinct values are joined with the domain, aggregated, and joined back; where
    the criteria are equalities and one range, running sums take the place of that join.
    """
    text, values = "", []
    pieces = _pieces(criteria)
    for i, piece in enumerate(pieces):
        if piece.kind == "string":
            part = piece.value
            if i and pieces[i - 1].kind != "string" and part[:1] in ("'", '"', "#"):
                part = part[1:]
            if i + 1 < len(pieces) and pieces[i + 1].kind != "string" and part[-1:] in ("'", '"', "#"):
                part = part[:-1]
            text += part
        else:
            text += f" [{column}_{len(values)}] "
            values.append(Compiler(context).column(piece))
    names = [f"{column}_{i}" for i in range(len(values))]
    keys = df.select(*[v.alias(n) for v, n in zip(values, names, strict=True)]).distinct()
    resolve = lambda path: F.col(path[-1]) if path[-1] in names else inner.resolve(path)
    both = replace(inner, resolve=resolve)
    split = split_criteria(parse(text), names)
    if split and kind in RUNNING:
        grouped = running_values(keys, domain, split, value, kind, names, inner, both).withColumnRenamed("__value", column)
    else:
        grouped = keys.join(domain, compile_expression(text, both)).groupBy(*names).agg(made)
    on = reduce(lambda a, b: a & b, [v.eqNullSafe(F.col(n)) for v, n in zip(values, names, strict=True)])
    return df.join(grouped, on, "left").drop(*names), F.coalesce(F.col(column), F.lit(0)) if kind == "count" else F.col(column)


def joined_sources(model: QueryModel, tables: Tables, params: dict[str, object] | None = None, order: str | None = None, null_concat: str = "sql", given: dict[str, DataFrame] | None = None) -> tuple[DataFrame, Context]:
    """The joined tables of a model, and the context in which its expressions find their columns.

    `given`: frames that take the place of the table of an alias.
    """
    frames = {s.key: (given[s.key] if given and s.key in given else tables(s.name)).alias(s.key) for s in model.sources}
    names = _Frames(frames)
    context = names.context(params=params or {}, null_concat=null_concat)
    if order:
        context = replace(context, order=context.resolve((order,)))
    df = None
    for step in fold_joins(model):
        other = frames[step.table]
        if df is None:
            df = other
        elif step.kind == "cross":
            df = df.crossJoin(other)
        else:
            on = [compile_expression(c, context) for c in step.conditions]
            condition = on[0]
            for c in on[1:]:
                condition = condition & c
            df = df.join(other, condition, step.kind)
    if df is None:
        raise CompileError("JOIN_GRAPH_NOT_RESOLVED", "no tables")
    return df, context


def first_percent(df: DataFrame, sorts: list[Column], percent: float) -> DataFrame:
    """The first `percent` of the rows by `sorts`, rounded up.

    Rows are dealt by ranges of the order and numbered within each; the ranges' sizes, a row
    each, give what lies before a range. So no task sees more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *sorts).sortWithinPartitions(*sorts) if sorts else df
    rows = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "top")
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = sizes.select("__part", (F.sum("__size").over(before) - F.col("__size")).alias("__start"), F.ceil(total * percent / 100).alias("__wanted"))
    numbered = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    out = numbered.filter(F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) < F.col("__wanted"))
    return out.orderBy("__at").select(*[bracketed(c) for c in df.columns])


def run_model(model: QueryModel, tables: Tables, params: dict[str, object] | None = None, ties: bool = False, order: str | None = None, null_concat: str = "sql", external: External | None = None) -> DataFrame:
    """The DataFrame of a select model.

    `params`: values of form references and prompts. `ties`: TOP keeps rows tied
    with the last one. `order`: the column by which First and Last choose. `external`:
    who runs SQL meant for a server.
    """
    if model.stored_sql is not None:
        return run_stored(model, tables, params, external)
    if model.query_type != "select":
        raise CompileError("NON_SELECT_QUERY_SQL_NOT_GENERATED", f"operation {model.operation}")
    df, context = joined_sources(model, tables, params, order, null_concat)
    trees = {text: parse(text) for text in [*(c.expression for c in model.columns), *(g.expression for g in model.groups), *(o.expression for o in model.ordering), *filter(None, (model.where, model.having))]}
    number = 0
    for tree in trees.values():
        for node in walk(tree):
            if node.kind == "call" and node.path[-1].lower() in DOMAIN and node not in context.replaced:
                df, context.replaced[node] = _attach_domain(df, node, number, tables, context, order)
                number += 1
    added = [c for i in range(number) for c in (f"__domain_{i}", f"__domain_{i}_key")]
    if model.where:
        df, more = filtered(df, trees[model.where], tables, context)
        added += more
    compiler = Compiler(context)

    outputs: list[tuple[str, Node, str]] = []
    for c in model.columns:
        tree = trees[c.expression]
        outputs.append((c.expression, tree, c.alias or (tree.path[-1] if tree.path and tree.kind != "call" else c.expression)))
    grouped = bool(model.groups) or any(_has_aggregate(t) for _, t, _ in outputs)
    late = [t for t in (*(t for _, t, _ in outputs), *(trees[o.expression] for o in model.ordering), *([trees[model.having]] if model.having else [])) if has_subquery(t)]
    if not grouped:
        df, more = attach(df, late, tables, context)
        added += more
    if grouped:
        keys = {trees[g.expression]: f"__group_{i}" for i, g in enumerate(model.groups)}
        measures: dict[Node, str] = {}
        wanted = [t for _, t, _ in outputs] + [trees[o.expression] for o in model.ordering] + ([trees[model.having]] if model.having else [])
        for tree in wanted:
            for node in walk(tree):
                if node.kind == "call" and node.path[-1].lower() in AGGREGATES and node not in measures:
                    measures[node] = f"__measure_{len(measures)}"
        made = [compiler.column(n).alias(a) for n, a in measures.items()]
        by = [compiler.column(n).alias(a) for n, a in keys.items()]
        if made:
            df = df.groupBy(*by).agg(*made)
        else:
            df = df.select(*by).distinct()
        after = replace(context, replaced={**{n: F.col(a) for n, a in keys.items()}, **{n: F.col(a) for n, a in measures.items()}})
        aliases = {a.casefold(): t for _, t, a in outputs}
        outer = after.resolve

        def resolve(path: tuple[str, ...]) -> Column | None:
            tail = path[-1].casefold()
            for node, alias in keys.items():
                if node.path and node.path[-1].casefold() == tail:
                    return F.col(alias)
            if len(path) == 1 and tail in aliases and not (aliases[tail].path and aliases[tail].path[-1].casefold() == tail):
                return Compiler(after).column(aliases[tail])
            return outer(path)

        after = replace(after, resolve=resolve)
        df, _ = attach(df, late, tables, after)
        compiler = Compiler(after)
        if model.having:
            df = df.filter(compiler.column(trees[model.having]))
    shown = []
    for _, tree, alias in outputs:
        shown.append(compiler.column(tree) if tree.kind == "star" else compiler.column(tree).alias(alias))
    known_aliases = {a.casefold(): a for _, t, a in outputs if t.kind != "star"}
    sorts: list[Column] = []
    extra: list[Column] = []
    for i, o in enumerate(model.ordering):
        tree = trees[o.expression]
        direct = next((a for _, t, a in outputs if t == tree and t.kind != "star"), None)
        if direct is None and len(tree.path) == 1 and tree.kind == "name":
            direct = known_aliases.get(tree.path[0].casefold())
        if direct is None:
            extra.append(compiler.column(tree).alias(f"__sort_{i}"))
            direct = f"__sort_{i}"
        sorts.append(F.col(bracketed(direct)).desc_nulls_last() if o.descending else F.col(bracketed(direct)).asc_nulls_first())
    everything = shown or [F.col("*")]
    if model.distinct:
        df = df.select(*everything, *extra).distinct()  # what DISTINCT is ordered by is among its columns
    else:
        df = df.select(*everything, *extra)
    if model.top and sorts and ties and not model.top.endswith("%"):
        # rank()<=n over one ordering: Spark's group limit keeps n rows and their ties a task before the last sort
        df = df.withColumn("__rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(*sorts))).filter(F.col("__rank") <= int(model.top)).drop("__rank").orderBy(*sorts)
    elif sorts:
        df = df.orderBy(*sorts)
    if model.top and model.top.endswith("%"):
        df = first_percent(df, sorts, float(model.top[:-1]))
    elif model.top and not (sorts and ties):
        df = df.limit(int(model.top))
    return df.drop(*added, *[f"__sort_{i}" for i in range(len(model.ordering))])


def run_query(definition: str, tables: Tables, **options) -> DataFrame:
    """Parses and runs a saved query."""
    return run_model(read_query(definition), tables, **options)
