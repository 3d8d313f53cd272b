"""Forms and reports as plans: record source, filter and order; group levels; value lists."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.columns import CompileError, compile_expression, frame_context
from gridspark.plans.clauses import split_commas
from gridspark.plans.execute import run_query
from gridspark.plans.tables import Tables
from gridspark.sources.forms import FormModel, GroupLevel

#: What a group level groups on, by its number.
EACH_VALUE, PREFIX, INTERVAL = 0, 1, 9
GROUP_ON = {2: "year", 3: "quarter", 4: "month", 5: "week", 6: "day", 7: "hour", 8: "minute"}


def ordering(text: str, df: DataFrame, params: dict[str, object] | None = None) -> list[Column]:
    """The sort columns of an OrderBy property: expressions, each with ASC or DESC or neither."""
    out = []
    for item in split_commas(text):
        m = re.fullmatch(r"(.*?)(?:\s+(ASC|DESC))?", item.strip(), re.I | re.S)
        column = compile_expression(m[1], frame_context(dict(df.dtypes), params))
        out.append(column.desc_nulls_last() if (m[2] or "").lower() == "desc" else column.asc_nulls_first())
    return out


def form_rows(model: FormModel, tables: Tables, params: dict[str, object] | None = None) -> DataFrame:
    """The rows that a form or report shows: its record source, with filter and order where they are on."""
    if not model.record_source:
        raise CompileError("SOURCE_DEFINITION_UNAVAILABLE", f"{model.name} has no record source")
    source = model.record_source.strip()
    if re.match(r"(SELECT|PARAMETERS|TRANSFORM)\b", source, re.I):
        text = source.replace("\\", "\\\\").replace('"', '\\"')
        df = run_query(f'dbMemo "SQL" ="{text}"\ndbMemo "Connect" =""\n', tables, params=params)
    else:
        df = tables(source.strip("[]"))
    if model.filter and model.filter_on:
        df = df.filter(compile_expression(model.filter, frame_context(dict(df.dtypes), params)))
    return df.orderBy(*ordering(model.order_by, df, params)) if model.order_by and model.order_by_on else df


def control_columns(model: FormModel, df: DataFrame, params: dict[str, object] | None = None) -> list[Column]:
    """What the bound and calculated controls of a form show, each under its control's name."""
    context = frame_context(dict(df.dtypes), params)
    return [compile_expression(b.source, context).alias(c.name) for c in model.controls for b in c.bindings if b.kind in ("column", "calculated")]


def group_key(level: GroupLevel, df: DataFrame) -> Column:
    """The value by which a group level groups: the whole value, its beginning, its interval or its part of time."""
    value = compile_expression(level.source, frame_context(dict(df.dtypes)))
    on, step = int(level.group_on or 0), int(level.interval or 1)
    if on == EACH_VALUE:
        return value
    if on == PREFIX:
        return F.left(value.cast("string"), F.lit(step))
    if on == INTERVAL:
        return F.floor(value / step) * step
    if on not in GROUP_ON or step < 1:
        raise CompileError("ROW_SOURCE_TYPE_NOT_A_QUERY", f"group on {on} by {step}")
    return F.date_trunc(GROUP_ON[on], value) if step == 1 else _spans(GROUP_ON[on], value, step)


def _spans(unit: str, value: Column, step: int) -> Column:
    """The beginning of the `step` years, months and so on that hold a time, counted from the unit with 30 December 1899,
    the dialect's day zero."""
    month, day = F.year(value) * 12 + F.month(value) - (1899 * 12 + 12), F.datediff(value, F.lit("1899-12-30").cast("date"))
    begin = lambda n: F.floor(n / step).cast("int") * step
    since = lambda date: F.lit(date).cast("date")
    made = {
        "year": lambda: F.add_months(since("1899-01-01"), 12 * begin(F.year(value) - 1899)),
        "quarter": lambda: F.add_months(since("1899-10-01"), 3 * begin(F.floor((month + 2) / 3))),
        "month": lambda: F.add_months(since("1899-12-01"), begin(month)),
        "week": lambda: F.date_add(since("1899-12-25"), 7 * begin(F.floor((day + 5) / 7))),
        "day": lambda: F.date_add(since("1899-12-30"), begin(day)),
    }
    if unit in made:
        return made[unit]().cast("timestamp")
    seconds = 3600 if unit == "hour" else 60
    zero = F.unix_timestamp(F.lit("1899-12-30").cast("timestamp"))
    return F.timestamp_seconds(zero + F.floor((F.unix_timestamp(value) - zero) / (seconds * step)) * (seconds * step))


def report_groups(model: FormModel, df: DataFrame, *measures: Column) -> DataFrame:
    """Measures by the report's group levels: groups, their headers' totals and the whole, in the levels' order.

    The columns of levels are group_0, group_1, ...; the total of an outer level has null in the inner ones.
    """
    keys = [group_key(g, df).alias(f"group_{i}") for i, g in enumerate(model.group_levels)]
    if not keys:
        return df.agg(*measures)
    made = df.select("*", *keys).rollup(*[f"group_{i}" for i in range(len(keys))]).agg(*measures)
    return made.orderBy(*[F.col(f"group_{i}").desc_nulls_last() if g.descending else F.col(f"group_{i}").asc_nulls_first() for i, g in enumerate(model.group_levels)])


def value_list(spark: SparkSession, text: str, columns: int = 1) -> DataFrame:
    """The rows of a value list, "a";"b";... cut into rows of `columns` texts; short rows end in null."""
    values = next(csv.reader([text], delimiter=";", quotechar='"', skipinitialspace=True), [])
    rows = [(i // columns, *(values[i : i + columns] + [None] * (columns - len(values[i : i + columns])))) for i in range(0, len(values), columns)]
    return spark.createDataFrame(rows, ", ".join(["ordinal int", *(f"column_{i} string" for i in range(columns))]))
