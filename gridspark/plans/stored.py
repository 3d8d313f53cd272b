"""Stored SQL: SELECT text as query models, and action queries as set operations.

Clauses are cut apart and their expressions compiled by the same compiler as those of
design grids, so functions, wildcards, dates and parameters mean the same; subqueries
inside them become joins. Tables are immutable; an action query gives the whole table
as it is afterwards.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import CompileError, Context, compile_expression, frame_context
from gridspark.functions.grammar import parse, walk

from .clauses import bare, clauses, fail, read_from, read_select, split_commas, unions, without_parameters, words
from .model import QueryModel, stored_kind
from .subqueries import attach, condition, filtered
from .tables import External, Tables, bracketed

def _one(sql: str, tables: Tables, params: dict[str, object]) -> DataFrame:
    """One SELECT, as a model; its subqueries in FROM are tables of their own."""
    from .execute import run_model

    model, inner = read_select(sql)
    nested = {name.casefold(): text for name, text in inner.items()}
    return run_model(model, lambda name: select(nested[name.casefold()], tables, params) if name.casefold() in nested else tables(name), params)


def select(sql: str, tables: Tables, params: dict[str, object]) -> DataFrame:
    """A SELECT or a UNION of them; rows of a UNION are ordered by its last ORDER BY."""
    parts = unions(sql)
    if len(parts) == 1:
        return _one(sql, tables, params)
    order = clauses(parts[-1][0], "order by").get("order by")
    last = parts[-1][0]
    if order:
        last = last[: next(a for w, a, _ in reversed(words(last)) if w == "order")]
    frames = [_one(p, tables, params) for p, _ in [*parts[:-1], (last, False)]]
    out = frames[0]
    for df, (_, every) in zip(frames[1:], parts[1:], strict=True):
        out = out.union(df)
        out = out if every else out.distinct()
    if order:
        context = frame_context(dict(out.dtypes), params)
        keys = [(re.sub(r"\s+(ASC|DESC)$", "", x, flags=re.I), re.search(r"\sDESC$", x, re.I)) for x in split_commas(order)]
        out = out.orderBy(*[compile_expression(x, context).desc_nulls_last() if d else compile_expression(x, context).asc_nulls_first() for x, d in keys])
    return out


def _crosstab(sql: str, tables: Tables, params: dict[str, object]) -> DataFrame:
    """TRANSFORM agg SELECT rows FROM source GROUP BY rows PIVOT column [IN (values)]."""
    from .execute import joined_sources

    body = clauses(sql, "transform", "select", "from", "where", "group by", "order by", "pivot")
    if not {"transform", "from", "group by", "pivot"} <= set(body):
        raise fail("crosstab")
    model = QueryModel("crosstab")
    nested: dict[str, str] = {}
    read_from(body["from"], model, nested)
    df, context = joined_sources(model, lambda name: select(nested[name], tables, params) if name in nested else tables(name), params)
    if "where" in body:
        df, _ = filtered(df, parse(body["where"]), tables, context)
    aliases = {}
    for item in split_commas(body["select"]):
        at = [(a, b) for w, a, b in words(item) if w == "as"]
        if at:
            aliases[item[: at[-1][0]].strip().casefold()] = bare(item[at[-1][1] :])
    at = [a for w, a, _ in words(body["transform"]) if w == "as"]
    measure = body["transform"][: at[-1]] if at else body["transform"]
    names = [aliases.get(x.casefold(), bare(x.split(".")[-1])) for x in split_commas(body["group by"])]
    by = [compile_expression(x, context).alias(n) for x, n in zip(split_commas(body["group by"]), names, strict=True)]
    column, listed = body["pivot"], None
    found = [(a, b) for w, a, b in words(column) if w == "in"]
    if found:
        inside = column[found[-1][1] :].strip()
        listed = [v.strip("'\"") for v in split_commas(inside[1:-1])]
        column = column[: found[-1][0]]
    keyed = df.withColumn("pivot_of", compile_expression(column, context))
    out = keyed.groupBy(*by).pivot("pivot_of", listed).agg(compile_expression(measure, context))
    if "order by" not in body:
        return out
    heads = {x.casefold(): n for x, n in zip(split_commas(body["group by"]), names, strict=True)} | {n.casefold(): n for n in names}
    keys = []
    for item in split_commas(body["order by"]):
        key = re.sub(r"\s+(ASC|DESC)$", "", item, flags=re.I)
        if key.casefold() not in heads:
            raise fail(f"crosstab ordered by {key}")
        c = F.col(bracketed(heads[key.casefold()]))
        keys.append(c.desc_nulls_last() if re.search(r"\sDESC$", item, re.I) else c.asc_nulls_first())
    return out.orderBy(*keys)


def _assignments(text: str, target: str, types: dict[str, tuple[str, str]], context: Context) -> dict[str, Column]:
    """Column to new value, of the list behind SET."""
    out = {}
    for item in split_commas(text):
        name, sep, value = item.partition("=")
        column = types.get(bare(name.strip().split(".")[-1]).lower())
        if not sep or column is None or ("." in name and bare(name.strip().split(".")[0]).casefold() != target.casefold()):
            raise fail(f"update of {name.strip()}")
        out[column[0]] = compile_expression(value, context).cast(column[1])
    return out


def _update(sql: str, tables: Tables, params: dict[str, object]) -> DataFrame:
    """UPDATE t SET ... [WHERE ...], and of t joined with other tables.

    With a join, a row that several rows match takes the least of their new values. The
    others are matched with the distinct values that the statement reads of t, so
    rows of t need no key and repeated ones change alike.
    """
    from .execute import joined_sources

    body = clauses(sql, "update", "set", "where")
    if not {"update", "set"} <= set(body):
        raise fail("update")
    model = QueryModel("update")
    read_from(body["update"], model, {})
    source = model.sources[0]
    df = tables(source.name)
    types = {c.lower(): (c, t) for c, t in df.dtypes}
    if len(model.sources) == 1:
        joined, context = joined_sources(model, tables, params)
        joined, hit, added = condition(joined, body["where"], tables, context) if "where" in body else (joined, F.lit(True), [])
        values = [x.partition("=")[2] for x in split_commas(body["set"])]
        joined, more = attach(joined, [parse(v) for v in values], tables, context)
        new = _assignments(body["set"], source.key, types, context)
        return joined.withColumns({c: F.when(hit, v).otherwise(F.col(bracketed(c))) for c, v in new.items()}).drop(*added, *more)
    texts = [*(j.on for j in model.joins), *([body["where"]] if "where" in body else []), *(x.partition("=")[2] for x in split_commas(body["set"]))]
    used = _read_of(source.key, texts, types, {c.lower() for s in model.sources[1:] for c in tables(s.name).columns})
    if not used:
        raise fail("update without a condition on its table")
    distinct = df.select(*map(bracketed, used)).distinct()
    joined, context = joined_sources(model, tables, params, given={source.key: distinct})
    if "where" in body:
        joined, _ = filtered(joined, parse(body["where"]), tables, context)
    new = _assignments(body["set"], source.key, types, context)
    keys = [context.resolve((source.key, c)).alias(f"key_{i}") for i, c in enumerate(used)]
    made = joined.groupBy(*keys).agg(F.min(F.struct(*[v.alias(c) for c, v in new.items()])).alias("changed"))
    match = reduce(lambda a, b: a & b, [df[bracketed(c)].eqNullSafe(F.col(f"key_{i}")) for i, c in enumerate(used)])
    out = df.join(made, match, "left")
    return out.select(*[(F.when(F.col("changed").isNotNull(), F.col(f"changed.{bracketed(c)}")).otherwise(df[bracketed(c)]) if c in new else df[bracketed(c)]).alias(c) for c in df.columns])


def _read_of(key: str, texts: list[str], own: dict[str, tuple[str, str]], elsewhere: set[str]) -> list[str]:
    """The columns of one table of a join that expressions read."""
    read = {n.path[-1].lower() for t in texts for n in walk(parse(t)) if n.path and (n.path[-2].casefold() == key.casefold() if len(n.path) > 1 else n.path[-1].lower() not in elsewhere)}
    return [own[c][0] for c in sorted(read & set(own))]


def _delete(sql: str, tables: Tables, params: dict[str, object]) -> DataFrame:
    """DELETE [t.*] FROM t [joined with others] [WHERE ...]: the rows of t that stay.

    With a join, the distinct values that the statement reads of t are matched, and rows of
    t that have such values go; so rows need no key.
    """
    from .execute import joined_sources

    body = clauses(sql, "delete", "from", "where")
    if "from" not in body:
        raise fail("delete")
    model = QueryModel("delete")
    read_from(body["from"], model, {})
    named = body.get("delete", "").rstrip("*").rstrip(".").strip()
    source = next((x for x in model.sources if x.key.casefold() == bare(named).casefold()), None) if named else model.sources[0]
    if source is None:
        raise fail(f"delete of {named}")
    df = tables(source.name)
    if len(model.sources) == 1:
        if "where" not in body:
            return df.limit(0)
        joined, context = joined_sources(model, tables, params)
        joined, hit, added = condition(joined, body["where"], tables, context)
        return joined.filter(~F.coalesce(hit, F.lit(False))).drop(*added)
    others = [x for x in model.sources if x is not source]
    texts = [*(j.on for j in model.joins), *([body["where"]] if "where" in body else [])]
    own = {c.lower(): (c, t) for c, t in df.dtypes}
    used = _read_of(source.key, texts, own, {c.lower() for x in others for c in tables(x.name).columns})
    if not used:
        raise fail("delete without a condition on its table")
    joined, context = joined_sources(model, tables, params, given={source.key: df.select(*map(bracketed, used)).distinct()})
    if "where" in body:
        joined, _ = filtered(joined, parse(body["where"]), tables, context)
    gone = joined.select(*[context.resolve((source.key, c)).alias(f"key_{i}") for i, c in enumerate(used)]).distinct()
    match = reduce(lambda a, b: a & b, [df[bracketed(c)].eqNullSafe(F.col(f"key_{i}")) for i, c in enumerate(used)])
    return df.join(gone, match, "left_anti")


def _insert(sql: str, tables: Tables, params: dict[str, object]) -> DataFrame:
    """INSERT INTO t [(columns)] SELECT ... or VALUES (...); columns that are not named are null."""
    m = re.match(r"\s*INSERT\s+INTO\s+(\[[^\]]+\]|\w+)\s*(?:\(([^)]*)\))?\s*(?=(SELECT|VALUES)\b)", sql, re.I)
    if not m:
        raise fail("insert")
    target = tables(bare(m[1]))
    rest = sql[m.end() :].strip()
    if m[3].lower() == "values":
        context = frame_context({}, params)
        lists = re.sub(r"^VALUES\s*", "", rest, flags=re.I)
        values = [compile_expression(v, context) for v in split_commas(lists.strip()[1:-1])]
        rows = target.sparkSession.range(1).select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    else:
        rows = select(rest, tables, params)
    columns = [bare(c) for c in m[2].split(",")] if m[2] else target.columns if m[3].lower() == "values" else rows.columns
    if len(columns) != len(rows.columns):
        raise fail("insert of another number of columns")
    rows = rows.toDF(*columns)
    have = {c.lower(): c for c in rows.columns}
    aligned = [(F.col(bracketed(have[c.lower()])) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in target.dtypes]
    return target.unionByName(rows.select(*aligned))


def run_stored(model: QueryModel, tables: Tables, params: dict[str, object] | None = None, external: External | None = None) -> DataFrame:
    """The rows of a stored query, of the table that it makes, or the table that an action query leaves behind.

    SQL for a server goes to `external(connect, sql)`, unread; without that it is refused.
    """
    if model.connect and external is not None:
        return external(model.connect, model.stored_sql or "")
    if model.connect:
        raise CompileError("PASS_THROUGH_QUERY_TARGETS_EXTERNAL_SERVER", model.connect)
    sql = without_parameters(model.stored_sql or "")
    run = {"select": select, "union": select, "make_table": select, "crosstab": _crosstab, "update": _update, "delete": _delete, "insert": _insert}.get(stored_kind(sql))
    if run is None:
        raise CompileError("STORED_SQL_NOT_RE_PARSED", stored_kind(sql))
    return run(sql, tables, params or {})
