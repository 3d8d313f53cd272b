"""Stored SQL clause by clause, data macros' refusals, forms and local time: what the registered queries leave out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridspark.catalogue import stored
from gridspark.functions.columns import CompileError, compile_expression, frame_context
from gridspark.operators import constraints, datamacros, screens
from gridspark.plans import clauses
from gridspark.plans.execute import run_query
from gridspark.plans.tables import linked_tables
from gridspark.sources import forms, schema
from gridspark.sources.macros import Handler, Statement


@pytest.fixture(scope="module")
def tables(spark):
    kegs = spark.createDataFrame([(1, "Ale", 10), (2, "Bock", 20), (3, "a, b", None)], "id int, name string, size int")
    taps = spark.createDataFrame([(1, "x"), (1, "w"), (4, "y")], "keg int, place string")
    return lambda name: {"kegs": kegs, "taps": taps}[name.lower()]


def rows(sql, tables, **options):
    return [tuple(r) for r in run_query(stored(sql), tables, **options).collect()]


def test_clauses_are_cut_outside_literals():
    text = "SELECT a AS [from x], 'where, b' FROM (SELECT 1 FROM q) AS s WHERE f(a, 'group by') GROUP BY a, b;"
    found = clauses.clauses(text, "select", "from", "where", "group by")
    assert found["where"] == "f(a, 'group by')" and clauses.split_commas(found["select"]) == ["a AS [from x]", "'where, b'"]
    assert [p for p, _ in clauses.unions("SELECT ' union ' UNION ALL SELECT 2 UNION SELECT 3")] == ["SELECT ' union '", "SELECT 2", "SELECT 3"]
    assert [k for _, k in clauses.unions("SELECT 1 UNION ALL SELECT 2 UNION SELECT 3")] == [False, True, False]
    assert clauses.without_parameters("PARAMETERS [a;b] Text; SELECT 1;") == "SELECT 1"


def test_stored_selects(tables):
    assert rows("SELECT DISTINCT TOP 2 k.* FROM kegs AS k ORDER BY k.id DESC", tables) == [(3, "a, b", None), (2, "Bock", 20)]
    assert rows("SELECT k.id, t.place FROM kegs k LEFT JOIN taps t ON (k.id = t.keg) WHERE Nz(t.place,'-') <> 'w' ORDER BY k.id", tables) == [(1, "x"), (2, None), (3, None)]
    assert rows("SELECT keg FROM taps UNION SELECT id FROM kegs ORDER BY keg DESC", tables) == [(4,), (3,), (2,), (1,)]
    assert rows("SELECT id FROM kegs WHERE id IN (SELECT keg FROM taps) AND Len(name)=3 AND name LIKE 'A*'", tables) == [(1,)]
    assert rows("SELECT name FROM kegs, taps WHERE id = keg AND place = [where]", tables, params={"where": "w"}) == [("Ale",)]
    assert rows("SELECT id INTO copied FROM kegs WHERE size IS NULL", tables) == [(3,)]


@pytest.mark.parametrize("sql", ["SELECT 1", "SELECT id FROM kegs LEFT JOIN (taps AS t INNER JOIN kegs AS q ON t.keg = q.id) ON kegs.id = t.keg", "SELECT id FROM kegs WHERE id IN (SELECT keg, place FROM taps)", "SELECT id FROM kegs WHERE id IN (SELECT TOP 1 keg FROM taps WHERE keg <= id ORDER BY keg)", "SELECT id FROM kegs INNER JOIN taps ON id = (SELECT Max(keg) FROM taps)", "DELETE * FROM kegs, taps", "DELETE x.* FROM kegs INNER JOIN taps ON id = keg", "INSERT INTO kegs (id, name) VALUES (1)", "UPDATE kegs INNER JOIN taps ON kegs.id = taps.keg SET taps.place = 'z'", "DROP TABLE kegs"])
def test_what_is_refused(tables, sql):
    with pytest.raises(CompileError):
        run_query(stored(sql), tables)


def test_actions(tables):
    assert rows("UPDATE kegs INNER JOIN taps ON kegs.id = taps.keg SET kegs.name = taps.place", tables)[0] == (1, "w", 10)  # the least of x and w
    assert rows("INSERT INTO kegs VALUES (9, 'it''s', Null)", tables)[-1] == (9, "it's", None)
    assert sorted(rows("DELETE FROM kegs WHERE size > 10", tables)) == [(1, "Ale", 10), (3, "a, b", None)]


def test_macros_refuse_what_one_pass_cannot_do(spark, tables):
    loop = lambda *inner: Handler("AfterInsert", [Statement("block", "ForEachRecord", {"Reference": "taps", "Alias": "t", "WhereCondition": "[t].[keg]=[id]"}, statements=list(inner))])
    with pytest.raises(CompileError):
        datamacros.run_handler(loop(Statement("action", "SetField", {"Field": "size", "Value": "[size]+1"}), Statement("block", "CreateRecord", {"Reference": "taps"})), tables("kegs"), tables)
    out = datamacros.run_handler(Handler("AfterInsert", [Statement("action", "OnError")]), tables("kegs"), tables)
    assert [f.detail for f in out.findings] == ["OnError"] and out.rows.count() == 3
    look = Statement("block", "LookUpRecord", {"Reference": "taps", "Alias": "t", "WhereCondition": "[t].[keg]>[id]"}, statements=[Statement("action", "SetField", {"Field": "name", "Value": "[t].[place]"})])
    assert sorted(tuple(r) for r in datamacros.run_handler(Handler("AfterInsert", [look]), tables("kegs"), tables).rows.collect()) == [(1, "y", 10), (2, "y", 20), (3, "y", None)]


def test_forms_and_groups(spark, tables):
    model = forms.read_form('Begin Form\n RecordSource ="SELECT name, size FROM kegs"\n Filter ="[size]>5"\n FilterOn =0\n OrderBy ="[size] DESC"\n OrderByOn =-1\nEnd\n', "f")
    assert [r.name for r in screens.form_rows(model, tables).collect()] == ["Bock", "Ale", "a, b"]
    with pytest.raises(CompileError):
        screens.form_rows(forms.FormModel("f", "form"), tables)
    level = forms.GroupLevel("size", False, "9", "15")
    assert sorted(r[0] for r in tables("kegs").select(screens.group_key(level, tables("kegs"))).collect() if r[0] is not None) == [0, 15]
    assert [tuple(r) for r in screens.value_list(spark, '"a";;"b ""c"""', 2).collect()] == [(0, "a", ""), (1, 'b "c"', None)]


def test_keys_and_lookups(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 1)], "a int, b int")
    relation = schema.Relationship("r", "c", "p", ["a", "b"], ["x", "y"], 0x1100)
    changes = spark.createDataFrame([((1, 2), (7, None))], "old struct<x:int,y:int>, new struct<x:int,y:int>")
    assert sorted(map(str, map(tuple, constraints.cascade_update(child, changes, relation).collect()))) == sorted(map(str, [(1, 1), (7, None), (2, 1), (None, 1)]))
    with pytest.raises(ValueError, match="2 columns"):
        constraints.cascade_update(child, spark.createDataFrame([(1, 2)], "old int, new int"), relation)


def test_days_are_added_in_local_time(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        df = spark.sql("SELECT timestamp'2024-03-30 12:30:00' AS t")
        made = lambda text: F.date_format(compile_expression(text, frame_context(dict(df.dtypes))), "yyyy-MM-dd HH:mm:ss")
        assert tuple(df.select(made('DateAdd("d",1,[t])'), made('DateAdd("m",1,[t])'), made('DateAdd("ww",-1,[t])'), made('DateAdd("h",24,[t])')).first()) == ("2024-03-31 12:30:00", "2024-04-30 12:30:00", "2024-03-23 12:30:00", "2024-03-31 12:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sql_for_a_server_and_linked_tables(spark, tables):
    text = 'dbMemo "SQL" ="EXEC report"\ndbMemo "Connect" ="ODBC;DSN=x"\n'
    with pytest.raises(CompileError, match="PASS_THROUGH"):
        run_query(text, tables)
    assert run_query(text, tables, external=lambda connect, sql: spark.createDataFrame([(connect, sql)], "c string, s string")).first() == ("ODBC;DSN=x", "EXEC report")
    linked = linked_tables(tables, {"Far": lambda: tables("taps")})
    assert rows("SELECT far.place FROM kegs INNER JOIN far ON kegs.id = far.keg WHERE far.place > 'w'", linked) == [("x",)]
