"""Subqueries inside expressions, running domain aggregates and patterns: what the registered queries leave out."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gridspark.catalogue import grid, stored
from gridspark.functions.columns import compile_expression, frame_context, like_regex
from gridspark.functions.grammar import parse
from gridspark.functions.neutral import analyse
from gridspark.plans.execute import run_query


@pytest.fixture(scope="module")
def tables(spark):
    kegs = spark.createDataFrame([(1, "Ale", 10), (2, "Bock", 20), (3, "a, b", None), (3, "a, b", None)], "id int, name string, size int")
    taps = spark.createDataFrame([(1, "x"), (1, "w"), (4, "y"), (None, "z")], "keg int, place string")
    return lambda name: {"kegs": kegs, "taps": taps, "none": taps.limit(0)}[name.lower()]


def rows(sql, tables, **options):
    return sorted((tuple(r) for r in run_query(stored(sql), tables, **options).collect()), key=str)


def test_trees():
    tree = parse("a Not In (Select 1 From t Where f(x) = ')') And Exists (SELECT 2) Or b <= Some (SELECT 3) And (SELECT 4) > exists(1)")
    kinds = [(n.kind, n.value, n.negated) for side in tree.children for n in [*side.children]]
    assert ("in_query", "Select 1 From t Where f(x) = ')'", True) in kinds and ("exists", "SELECT 2", False) in kinds and ("quantified", "SELECT 3", False) in kinds
    assert analyse("(SELECT 1)").findings[0].reason_code == "EXPRESSION_PARSE_FAILED"
    for bad in ("x In (Select 1", "(Select 1"):
        with pytest.raises(ValueError):
            parse(bad)


def test_three_values(tables):
    # 3 is not among keg's values, but a null is: the answer is null, for IN and NOT IN alike
    assert rows("SELECT DISTINCT id, IIf(id IN (SELECT keg FROM taps),'y','n') AS a, id NOT IN (SELECT keg FROM taps) AS b, id IN (SELECT keg FROM none) AS c FROM kegs", tables) == [(1, "y", False, False), (2, "n", None, False), (3, "n", None, False)]
    assert rows("SELECT DISTINCT id, id >= ALL (SELECT keg FROM none) AS a, id < ANY (SELECT keg FROM taps) AS b, id = ALL (SELECT keg FROM taps WHERE keg < 2) AS c, id <> ANY (SELECT keg FROM taps WHERE keg < 2) AS d FROM kegs", tables) == [(1, True, True, True, False), (2, True, True, False, True), (3, True, True, False, True)]
    assert rows("SELECT keg FROM taps WHERE keg NOT IN (SELECT id FROM kegs)", tables) == [(4,)]


def test_rows_are_not_multiplied(tables):
    assert rows("SELECT id, (SELECT Count(*) FROM taps WHERE keg = id) AS n FROM kegs", tables) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert len(rows("SELECT k.id FROM kegs AS k WHERE EXISTS (SELECT * FROM kegs AS q WHERE q.id >= k.id)", tables)) == 4
    assert rows("SELECT id FROM kegs WHERE id IN (SELECT keg FROM taps UNION SELECT size/10 FROM kegs)", tables) == [(1,), (2,)]
    assert rows("SELECT * FROM kegs WHERE id = (SELECT Max(keg) FROM taps WHERE keg < 3)", tables) == [(1, "Ale", 10)]


def test_one_record_at_most(tables):
    with pytest.raises(Exception, match="at most one record"):
        rows("SELECT (SELECT keg FROM taps) AS k FROM kegs", tables)


def test_a_match_is_one_join(tables):
    plan = run_query(stored("SELECT id FROM kegs WHERE EXISTS (SELECT * FROM taps WHERE keg = id AND place <> name) AND id IN (SELECT keg FROM taps)"), tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") >= 2 and "NestedLoop" not in plan and "Cartesian" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_running_aggregates(spark, op):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    data = [(i, i % 3 if i % 11 else None, (i * 7) % 13 if i % 5 else None, i % 4) for i in range(60)]
    t = spark.createDataFrame(data, "id int, g int, at int, x int")
    calls = [(f'D{f}("x","t","g=" & [g] & " And at{op}" & [at])', f) for f in ("Sum", "Count", "Min", "Max", "Avg")]
    df = run_query(grid(["t"], ["t.id", *calls]), lambda name: t)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    holds = {"<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}[op]
    for r in df.collect():
        _, g, at, _ = data[r.id]
        xs = [x for _, h, b, x in data if g is not None and at is not None and h == g and b is not None and holds(b, at)]
        assert (r.Sum, r.Count, r.Min, r.Max, r.Avg) == ((sum(xs), len(xs), min(xs), max(xs), sum(xs) / len(xs)) if xs else (None, 0, None, None, None))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_patterns(spark):
    cases = [("a*c", "a\nbc", True), ("a?c", "abc", True), ("#[!0-9]", "1a", True), ("#[!0-9]", "11", False), ("[*]", "*", True), ("[*]", "a", False), ("[a-c]", "d", False), ("[]", "[]", True), ("[", "[", True), ("a.b", "axb", False), ("[!]", "!", True), ("[\\^]", "^", True), ("C:\\*", "C:\\x", True), ("%_", "%_", True), ("%_", "ab", False), ("", "", True), ("A*", "abc", False)]
    df = spark.createDataFrame([(p, v) for p, v, _ in cases], "p string, v string")
    got = df.select(compile_expression("v Like p", frame_context(dict(df.dtypes))).alias("r")).collect()
    for (p, v, want), r in zip(cases, got, strict=True):
        assert r.r is want and bool(re.search(like_regex(p).replace("\\z", "\\Z"), v)) is want, (p, v)
        literal = p.replace("'", "''")
        assert df.filter(F.col("v") == v).select(compile_expression(f"v Like '{literal}'", frame_context(dict(df.dtypes))).alias("r")).first().r is want, (p, v)
    assert df.filter("v = 'abc'").select(compile_expression("v Like 'A[B-C]*'", frame_context(dict(df.dtypes), case_sensitive_like=False)).alias("r")).first().r
