"""Saved queries: text form, model, findings, and results against DuckDB."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from gridspark import catalogue_models  # noqa: F401
from gridspark.catalogue import QUERIES, SQL, grid, stored
from gridspark.functions.columns import CompileError
from gridspark.plans.execute import run_query
from gridspark.plans.model import read_query, stored_kind
from gridspark.plans.textformat import parse_text, split_code, unescape

SF = "/root/testdata/sf0.001"
SIMPLE = grid(["Companies"], ["Companies.CompanyID", ("Companies.Name", "Label")], order=["Companies.Name"])


def codes(model):
    return {f.reason_code for f in model.findings}


def test_text_form():
    assert unescape(r"a\015\012b") == "a\r\nb" and unescape(r"say \"hi\" \\ ok \q") == 'say "hi" \\ ok \\q'
    root = parse_text('Where ="(a And "\n    "b)"\ndbBoolean "ReturnsRecords" ="-1"\ndbBinary "GUID" = Begin\n 0x2c ,\n 0x20\n End\nEnd\nBegin Form\n Begin\n  Begin Label\n   Name ="x"\n  End\n End\nEnd\n')
    assert root.get("where") == "(a And b)"
    assert root.properties[1].db_type == "dbBoolean"
    assert root.properties[2].binary == ("0x2c", "0x20")
    assert root.blocks("Form")[0].children[0].children[0].get("Name") == "x"
    body, code = split_code("Begin Form\r\nEnd\r\nOption Compare Database\r\nSub A()\r\n")
    assert code.startswith("Option") and "Option" not in body
    assert split_code("Begin Form\nEnd\n")[1] is None
    with pytest.raises(ValueError):
        parse_text("Begin A\n" * 300)


def test_models():
    m = read_query(SIMPLE)
    assert m.sql == "SELECT Companies.CompanyID, Companies.Name AS Label\nFROM Companies\nORDER BY Companies.Name ASC" and m.translated
    m = read_query(grid(["Orders", "Employees", ("Employees", "Approver")], ["Orders.OrderID"], joins=[("Orders", "Employees", "Orders.E = Employees.ID", 1), ("Orders", "Approver", "Orders.A = Approver.ID", 2)]))
    assert "Employees AS Approver" in m.sql and "LEFT OUTER JOIN" in m.sql and "IMPLICIT_CROSS_JOIN" not in codes(m)
    m = read_query(grid(["Orders"], ["Orders.*"], option=18, top=20))
    assert m.distinct and m.top == "20" and "SELECT DISTINCT TOP 20" in m.sql and "TOP_CLAUSE_IS_DIALECT_SPECIFIC" in codes(m) and m.translated
    m = read_query(grid(["A", "B"], ["A.X"]))
    assert "IMPLICIT_CROSS_JOIN" in codes(m) and not m.translated
    m = read_query(grid(["A"], ["A.X"], option=64))
    assert "QUERY_OPTION_BITS_NOT_MAPPED" in codes(m)
    m = read_query(grid(["A", "B"], ["A.X"], joins=[("A", "B", "A.x=B.x", 9), ("A", "C", "A.x=C.x", 1)]))
    assert {"JOIN_FLAG_NOT_MAPPED", "JOIN_GRAPH_NOT_RESOLVED"} <= codes(m)
    m = read_query(SIMPLE.replace("Operation =1", "Operation =7"))
    assert m.query_type == "unknown" and m.sql is None and "QUERY_OPERATION_CODE_NOT_MAPPED" in codes(m)


def test_stored_kinds():
    m = read_query(stored("SELECT a FROM T UNION ALL SELECT b FROM U;"))
    assert m.query_type == "union" and m.dependencies == ["T", "U"] and "STORED_SQL_NOT_RE_PARSED" in codes(m)
    assert read_query('dbMemo "SQL" ="SELECT 1"\ndbMemo "Connect" ="ODBC;DSN=x"\n').query_type == "pass_through"
    assert stored_kind("SELECT [my union] FROM t") == "select" and stored_kind("PARAMETERS a Text; SELECT 1") == "select" and stored_kind("SELECT * INTO x FROM y") == "make_table"


def test_refused_queries(spark):
    with pytest.raises(CompileError):
        run_query(SIMPLE.replace("Operation =1", "Operation =7"), lambda name: None)
    with pytest.raises(CompileError):
        run_query('dbMemo "SQL" ="SELECT 1"\ndbMemo "Connect" ="ODBC;DSN=x"\n', lambda name: None)


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return int(v) if isinstance(v, bool) else v


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    cursor = oracle.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert _rows([r[c] for c in order] for r in df.collect()) == _rows([r[i] for i in at] for r in cursor.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["grid_pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_partkey" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
