"""The registered queries over the driver tables, with DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.plans.execute import run_query
from gridspark.plans.tables import parquet_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def grid(tables, columns, where=None, joins=(), groups=(), having=None, order=(), option=0, top=None, operation=1) -> str:
    """Design-grid text. tables: names or (name, alias); columns: expressions or (expression, alias);
    joins: (left, right, on, flag); order: expressions or (expression, 1 for descending)."""
    lines = [f"Operation ={operation}", f"Option ={option}"]
    if top is not None:
        lines.append(f'RowCount ="{top}"')
    if where:
        lines.append(f"Where ={quoted(where)}")
    if having:
        lines.append(f"Having ={quoted(having)}")

    def block(name, body):
        if body:
            lines.extend([f"Begin {name}", *[f"    {x}" for x in body], "End"])

    pair = lambda x: x if isinstance(x, tuple) else (x, None)
    block("InputTables", [y for n, a in map(pair, tables) for y in [f'Name ="{n}"', *([f'Alias ="{a}"'] if a else [])]])
    block("OutputColumns", [y for e, a in map(pair, columns) for y in [*([f'Alias ="{a}"'] if a else []), f"Expression ={quoted(e)}"]])
    block("Joins", [y for left, right, on, flag in joins for y in (f'LeftTable ="{left}"', f'RightTable ="{right}"', f"Expression ={quoted(on)}", f"Flag ={flag}")])
    block("OrderBy", [y for e, d in map(pair, order) for y in (f"Expression ={quoted(e)}", f"Flag ={d or 0}")])
    block("Groups", [y for g in groups for y in (f"Expression ={quoted(g)}", "GroupLevel =0")])
    return "\n".join(lines) + "\n"


def stored(sql: str) -> str:
    return f'dbMemo "SQL" ={quoted(sql)}\ndbMemo "Connect" =""\n'


def add(name: str, definition: str, sql: str, **options) -> None:
    """Registers a saved query under `name`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_query(definition, parquet_tables(spark, sf_dir), **options)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


PRICING = grid(
    ["lineitem"],
    ["lineitem.l_returnflag", "lineitem.l_linestatus", ("Round(Sum(lineitem.l_quantity),2)", "sum_qty"), ("Round(Sum(lineitem.l_extendedprice*(1-lineitem.l_discount)),2)", "sum_disc_price"), ("Round(Avg(lineitem.l_discount),6)", "avg_disc"), ("Count(*)", "count_order")],
    where="(((lineitem.l_shipdate)<=#9/2/2000#))",
    groups=["lineitem.l_returnflag", "lineitem.l_linestatus"],
    order=["lineitem.l_returnflag", "lineitem.l_linestatus"],
)
add("grid_pricing_summary", PRICING, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS sum_qty, round(sum(l_extendedprice*(1-l_discount)),2) AS sum_disc_price, round(avg(l_discount),6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1,2 ORDER BY 1,2")

# projections
add("grid_select_alias_order", grid(["customer"], [("customer.c_custkey", "id"), ("customer.c_name", "Label")], order=["customer.c_name"]), 'SELECT c_custkey AS id, c_name AS "Label" FROM customer ORDER BY c_name')
add("grid_star", grid(["nation"], ["nation.*"]), "SELECT * FROM nation")
add("grid_empty_projection", grid(["region"], []), "SELECT * FROM region")
add("grid_quoted_alias", grid(["part"], [("[part].[p_partkey]", "part no"), ("[part].[p_retailprice]*2", "double price")]), 'SELECT p_partkey AS "part no", p_retailprice*2 AS "double price" FROM part')

# predicates
_O = "o_orderkey, o_totalprice"
_OC = ["orders.o_orderkey", "orders.o_totalprice"]
for _name, _where, _sql in (
    ("compare", "orders.o_totalprice>=100000 And orders.o_orderstatus<>'P'", "o_totalprice >= 100000 AND o_orderstatus <> 'P'"),
    ("between", "orders.o_totalprice Between 50000 And 60000", "o_totalprice BETWEEN 50000 AND 60000"),
    ("in", "orders.o_orderstatus In ('F','P')", "o_orderstatus IN ('F','P')"),
    ("isnull", "IIf(orders.o_orderstatus='P',Null,orders.o_totalprice) Is Null", "o_orderstatus = 'P'"),
    ("like", "orders.o_orderpriority Like '?-*H*'", "o_orderpriority LIKE '_-%H%' ESCAPE '\\'"),
    ("not", "Not orders.o_orderstatus='F'", "NOT o_orderstatus = 'F'"),
    ("xor", "orders.o_totalprice>100000 Xor orders.o_orderstatus='F'", "(o_totalprice > 100000) <> (o_orderstatus = 'F')"),
    ("not_in", "orders.o_orderstatus Not In ('F','O') Or orders.o_orderpriority Not Like '1*'", "o_orderstatus NOT IN ('F','O') OR o_orderpriority NOT LIKE '1%'"),
    ("eqv", "(orders.o_totalprice>100000) Eqv (orders.o_orderstatus='F')", "(o_totalprice > 100000) = (o_orderstatus = 'F')"),
    ("imp", "(orders.o_totalprice>100000) Imp (orders.o_orderstatus='F')", "NOT (o_totalprice > 100000) OR o_orderstatus = 'F'"),
    ("date_literal", "orders.o_orderdate>=#1/1/1997# And orders.o_orderdate<#7/1/1997 12:00:00 PM#", "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01 12:00:00'"),
):
    add(f"grid_where_{_name}", grid(["orders"], _OC, where=_where), f"SELECT {_O} FROM orders WHERE {_sql}")
add("param_form_reference", grid(["orders"], _OC, where="orders.o_totalprice>[Forms]![frmFilter]![txtLow] And orders.o_orderstatus=[Which status]"), f"SELECT {_O} FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'", params={"Forms_frmFilter_txtLow": 150000, "Which status": "O"})

# joins
_CO = ("customer", "orders", "customer.c_custkey=orders.o_custkey")
_CN = ["customer.c_custkey", "nation.n_name"]
add("grid_join_inner", grid(["customer", "orders"], ["customer.c_name", "orders.o_orderkey"], joins=[(*_CO, 1)]), "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
add("grid_join_left", grid(["customer", "nation"], _CN, joins=[("customer", "nation", "customer.c_nationkey=nation.n_nationkey And nation.n_regionkey=1", 2)]), "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
add("grid_join_right", grid(["nation", "region"], ["nation.n_name", "region.r_name"], joins=[("nation", "region", "nation.n_regionkey=region.r_regionkey And nation.n_nationkey<7", 3)]), "SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 7")
add("grid_join_flip", grid(["region", "nation"], ["nation.n_name", "region.r_name"], joins=[("nation", "region", "nation.n_regionkey=region.r_regionkey And region.r_regionkey<3", 2)]), "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
add("grid_join_self_alias", grid(["nation", ("nation", "Peer")], [("nation.n_name", "name"), ("Peer.n_name", "peer")], joins=[("nation", "Peer", "nation.n_regionkey=Peer.n_regionkey And nation.n_nationkey<Peer.n_nationkey", 1)]), "SELECT a.n_name AS name, b.n_name AS peer FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("grid_join_theta", grid(["nation", "region"], ["nation.n_name", "region.r_name"], joins=[("nation", "region", "nation.n_regionkey>region.r_regionkey", 1)]), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
add("grid_join_composite", grid(["supplier", "customer"], [("Count(*)", "n")], joins=[("supplier", "customer", "supplier.s_nationkey=customer.c_nationkey", 1), ("supplier", "customer", "supplier.s_suppkey=customer.c_custkey", 1)]), "SELECT count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
add("grid_join_cross", grid(["region", "nation"], ["region.r_name", "nation.n_name"]), "SELECT r_name, n_name FROM region CROSS JOIN nation")
add("grid_join_three", grid(["region", "nation", "customer"], ["region.r_name", ("Count(*)", "n")], joins=[("nation", "customer", "nation.n_nationkey=customer.c_nationkey", 1), ("region", "nation", "region.r_regionkey=nation.n_regionkey", 1)], groups=["region.r_name"]), "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name")

# grouping, distinct, top
add("grid_group_having", grid(["orders"], ["orders.o_custkey", ("Count(*)", "n"), ("Round(Sum(orders.o_totalprice),2)", "total")], groups=["orders.o_custkey"], having="Count(*)>8 And Sum(orders.o_totalprice)>500000"), "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 8 AND sum(o_totalprice) > 500000")
add("grid_group_expression", grid(["orders"], [("Year(orders.o_orderdate)", "y"), ("Count(*)", "n"), ("Round(Sum(orders.o_totalprice)/Count(*),1)", "mean")], groups=["Year(orders.o_orderdate)"], order=[("Year(orders.o_orderdate)", 1)]), "SELECT year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice)/count(*),1) AS mean FROM orders GROUP BY 1 ORDER BY 1 DESC")
add("grid_global_agg", grid(["lineitem"], [("Count(*)", "n"), ("Min(lineitem.l_shipdate)", "first_day"), ("Max(lineitem.l_extendedprice)", "top_price")]), "SELECT count(*) AS n, min(l_shipdate) AS first_day, max(l_extendedprice) AS top_price FROM lineitem")
add("grid_distinct", grid(["orders"], ["orders.o_orderstatus", "orders.o_orderpriority"], option=2), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("grid_top", grid(["orders"], _OC, option=16, top=20, order=[("orders.o_totalprice", 1), "orders.o_orderkey"]), f"SELECT {_O} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("grid_top_ties", grid(["part"], ["part.p_partkey", "part.p_size"], option=16, top=25, order=["part.p_size"]), "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 25", ties=True)
add("grid_top_distinct", grid(["lineitem"], ["lineitem.l_suppkey"], option=18, top=15, order=[("lineitem.l_suppkey", 1)]), "SELECT DISTINCT l_suppkey FROM lineitem ORDER BY l_suppkey DESC LIMIT 15")
add("agg_statistics", grid(["lineitem"], ["lineitem.l_returnflag", *[(f"Round({f}(lineitem.l_quantity),6)", f.lower()) for f in ("StDev", "StDevP", "Var", "VarP", "Avg")]], groups=["lineitem.l_returnflag"]), "SELECT l_returnflag, round(stddev_samp(l_quantity),6) AS stdev, round(stddev_pop(l_quantity),6) AS stdevp, round(var_samp(l_quantity),6) AS \"var\", round(var_pop(l_quantity),6) AS varp, round(avg(l_quantity),6) AS avg FROM lineitem GROUP BY 1")
add("agg_first_last", grid(["events"], ["events.event_type", ("First(events.value)", "first_value"), ("Last(events.value)", "last_value")], groups=["events.event_type"]), "SELECT event_type, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY 1", order="event_id")

# expressions
_L = ["lineitem.l_orderkey", "lineitem.l_linenumber"]
_LS = "l_orderkey, l_linenumber"


def expressions(name: str, table: str, keys: list[str], pairs: list[tuple[str, str, str]], **options) -> None:
    """A query of key columns and expressions: (alias, expression, SQL)."""
    add(name, grid([table], [*[f"{table}.{k}" for k in keys], *[(e, a) for a, e, _ in pairs]]), f"SELECT {', '.join(keys)}, {', '.join(f'{s} AS {a}' for a, _, s in pairs)} FROM {table}", **options)


_LK = ["l_orderkey", "l_linenumber"]
expressions("expr_arith", "lineitem", _LK, [("a", "Round(l_quantity+l_extendedprice*l_discount-l_tax,6)", "round(l_quantity+l_extendedprice*l_discount-l_tax,6)"), ("b", "-l_quantity^2", "-pow(l_quantity,2)"), ("c", "l_extendedprice/l_quantity", "l_extendedprice/nullif(l_quantity,0)"), ("d", "l_linenumber/(l_linenumber-1)", "l_linenumber::DOUBLE/nullif(l_linenumber-1,0)")])
expressions("expr_intdiv_mod_pow", "lineitem", _LK, [("q", "l_orderkey\\7", "CAST(trunc(l_orderkey/7) AS BIGINT)"), ("m", "l_orderkey Mod 7", "l_orderkey % 7"), ("p", "l_linenumber^3", "pow(l_linenumber,3)"), ("x", "10+l_orderkey Mod 5*2", "10+(l_orderkey % (5*2))")])
expressions("expr_concat", "customer", ["c_custkey"], [("t", 'c_name & " / " & c_mktsegment & 1+1', "c_name || ' / ' || c_mktsegment || '2'")])
expressions("expr_concat_nulls", "customer", ["c_custkey"], [("t", 'c_name & IIf(c_acctbal>0,Null,"-debt")', "c_name || CASE WHEN c_acctbal > 0 THEN '' ELSE '-debt' END")], null_concat="access")
expressions("expr_concat_nulls_sql", "customer", ["c_custkey"], [("t", 'c_name & IIf(c_acctbal>0,Null,"-debt")', "c_name || CASE WHEN c_acctbal > 0 THEN NULL ELSE '-debt' END")])
expressions("expr_iif_switch_choose", "orders", ["o_orderkey"], [("i", 'IIf(o_totalprice>100000,"big","small")', "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END"), ("s", 'Switch(o_orderstatus="F",1,o_orderstatus="O",2)', "CASE WHEN o_orderstatus='F' THEN 1 WHEN o_orderstatus='O' THEN 2 END"), ("c", 'Choose(o_orderkey Mod 4,"one","two","three")', "CASE o_orderkey % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END")])
expressions("expr_nz_isnull", "orders", ["o_orderkey"], [("n", "Nz(IIf(o_orderstatus='F',Null,o_totalprice),0)", "CASE WHEN o_orderstatus='F' THEN 0 ELSE o_totalprice END"), ("z", "IsNull(IIf(o_orderstatus='F',Null,1))", "o_orderstatus='F'"), ("e", "Nz(o_orderpriority)", "coalesce(o_orderpriority,'')")])
expressions("expr_strings", "part", ["p_partkey"], [("u", "UCase(p_name)", "upper(p_name)"), ("l", "LCase(p_brand)", "lower(p_brand)"), ("n", "Len(p_type)", "length(p_type)"), ("a", "Left(p_name,4)", "left(p_name,4)"), ("b", "Right$(p_name,3)", "right(p_name,3)"), ("t", 'Trim("  " & p_brand & " ") & LTrim("  x") & RTrim("y  ")', "p_brand || 'x' || 'y'"), ("r", 'Replace(p_brand,"#","no ")', "replace(p_brand,'#','no ')")])
expressions("expr_instr_mid", "part", ["p_partkey"], [("i", 'InStr(p_name,"e")', "instr(p_name,'e')"), ("j", 'InStr(3,p_name,"e")', "CASE WHEN instr(substr(p_name,3),'e')=0 THEN 0 ELSE instr(substr(p_name,3),'e')+2 END"), ("m", "Mid(p_name,2,3)", "substr(p_name,2,3)"), ("k", "Mid(p_name,4)", "substr(p_name,4)")])
expressions("expr_space_string", "part", ["p_partkey"], [("s", '"[" & Space(3) & "]"', "'[   ]'"), ("t", 'String(p_size Mod 5,"ab")', "repeat('a', p_size % 5)")])
expressions("expr_asc_chr", "part", ["p_partkey"], [("a", "Asc(p_name)", "ascii(p_name)"), ("c", "Chr(65+p_size Mod 26)", "chr(65 + p_size % 26)")])
expressions("expr_numeric", "lineitem", _LK, [("a", "Abs(l_tax-l_discount)", "abs(l_tax-l_discount)"), ("s", "Sgn(l_tax-l_discount)", "CAST(sign(l_tax-l_discount) AS INTEGER)"), ("q", "Round(Sqr(l_quantity),6)", "round(sqrt(l_quantity),6)"), ("e", "Round(Exp(l_tax),6)", "round(exp(l_tax),6)"), ("g", "Round(Log(l_quantity),6)", "round(ln(l_quantity),6)")])
expressions("expr_int_fix", "lineitem", _LK, [("i", "Int(l_quantity-25.5)", "CAST(floor(l_quantity-25.5) AS BIGINT)"), ("f", "Fix(l_quantity-25.5)", "CAST(trunc(l_quantity-25.5) AS BIGINT)")])
expressions("expr_round", "lineitem", _LK, [("r", "Round(l_extendedprice)", "round(l_extendedprice)"), ("r1", "Round(l_extendedprice,1)", "round(l_extendedprice,1)")])
expressions("expr_convert", "orders", ["o_orderkey"], [("i", "CLng(o_totalprice)", "CAST(round_even(o_totalprice,0) AS INTEGER)"), ("d", "CDbl(o_orderkey)", "CAST(o_orderkey AS DOUBLE)"), ("s", "CStr(o_orderkey)", "CAST(o_orderkey AS VARCHAR)"), ("c", "CCur(o_orderkey)", "CAST(o_orderkey AS DECIMAL(19,4))"), ("b", "CBool(o_orderkey Mod 2)", "CAST(o_orderkey % 2 AS BOOLEAN)")])
expressions("expr_val_isnumeric", "part", ["p_partkey"], [("v", 'Val(Replace(p_brand,"Brand#","") & " x")', "coalesce(try_cast(regexp_extract(replace(p_brand,'Brand#','') || ' x','^\\s*([0-9.]+)',1) AS DOUBLE),0)"), ("n", "IsNumeric(p_brand)", "try_cast(p_brand AS DOUBLE) IS NOT NULL"), ("y", 'IsNumeric(p_size & ".5")', "true"), ("d", 'IsDate("2020-01-" & p_size)', "try_cast('2020-01-' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || CAST(p_size AS VARCHAR) AS TIMESTAMP) IS NOT NULL")])
expressions("expr_date_parts", "orders", ["o_orderkey"], [("y", "Year(o_orderdate)", "year(o_orderdate)"), ("m", "Month(o_orderdate)", "month(o_orderdate)"), ("d", "Day(o_orderdate)", "day(o_orderdate)"), ("h", "Hour(o_orderdate)", "hour(o_orderdate)"), ("n", "Minute(o_orderdate)", "minute(o_orderdate)"), ("s", "Second(o_orderdate)", "second(o_orderdate)"), ("q", 'DatePart("q",o_orderdate)', "quarter(o_orderdate)"), ("dy", 'DatePart("y",o_orderdate)', "dayofyear(o_orderdate)")])
expressions("expr_date_add_diff", "orders", ["o_orderkey"], [("m", 'DateAdd("m",1,o_orderdate)', "o_orderdate + INTERVAL 1 MONTH"), ("w", 'DateAdd("d",-10,o_orderdate)', "o_orderdate - INTERVAL 10 DAY"), ("dm", 'DateDiff("m",#1/15/1995#,o_orderdate)', "date_diff('month', TIMESTAMP '1995-01-15', o_orderdate)"), ("dd", 'DateDiff("d",#1/15/1995#,o_orderdate)', "date_diff('day', TIMESTAMP '1995-01-15', o_orderdate)"), ("dy", 'DateDiff("yyyy",#12/31/1994#,o_orderdate)', "date_diff('year', TIMESTAMP '1994-12-31', o_orderdate)"), ("dh", 'DateDiff("h",#1/1/1995 10:30:00#,o_orderdate)', "date_diff('hour', TIMESTAMP '1995-01-01 10:30:00', o_orderdate)")])
expressions("expr_date_serial", "orders", ["o_orderkey"], [("a", "DateSerial(Year(o_orderdate),Month(o_orderdate)+13,0)", "CAST(make_date(year(o_orderdate),1,1) + to_months(CAST(month(o_orderdate)+12 AS INTEGER)) - INTERVAL 1 DAY AS DATE)"), ("t", "TimeSerial(25,o_orderkey Mod 60,5)", "'01:' || lpad(CAST(o_orderkey % 60 AS VARCHAR),2,'0') || ':05'"), ("v", 'DateValue("2020-02-29")', "DATE '2020-02-29'")])
expressions("expr_weekday", "orders", ["o_orderkey"], [("w", "Weekday(o_orderdate)", "dayofweek(o_orderdate)+1"), ("x", 'DatePart("w",o_orderdate)', "dayofweek(o_orderdate)+1")])
expressions("expr_format", "orders", ["o_orderkey"], [("d", 'Format(o_orderdate,"yyyy-mm-dd")', "strftime(o_orderdate,'%Y-%m-%d')"), ("m", 'Format(o_orderdate,"mmm yyyy")', "strftime(o_orderdate,'%b %Y')"), ("n", 'Format(o_orderkey,"#,##0.00")', "format('{:,}', o_orderkey) || '.00'"), ("z", 'Format(o_orderkey,"0")', "CAST(o_orderkey AS VARCHAR)")])
expressions("expr_partition", "part", ["p_partkey"], [("b", "Partition(p_size,10,39,10)", "CASE WHEN p_size<10 THEN '  : 9' WHEN p_size>39 THEN '40:  ' ELSE CAST(p_size//10*10 AS VARCHAR) || ':' || CAST(p_size//10*10+9 AS VARCHAR) END")])

# domain aggregates
add("domain_dlookup", grid(["orders"], ["orders.o_orderkey", ('DLookUp("r_name","region","r_regionkey=2")', "region")]), "SELECT o_orderkey, (SELECT r_name FROM region WHERE r_regionkey=2) AS region FROM orders")
add("domain_dcount_dsum", grid(["nation"], ["nation.n_name", ('DCount("*","customer","c_acctbal>0")', "n"), ('Round(DSum("c_acctbal","customer"),2)', "total"), ('DMax("c_acctbal","customer")', "top")]), "SELECT n_name, (SELECT count(*) FROM customer WHERE c_acctbal>0) AS n, (SELECT round(sum(c_acctbal),2) FROM customer) AS total, (SELECT max(c_acctbal) FROM customer) AS top FROM nation")
add("domain_correlated", grid(["customer"], ["customer.c_custkey", ('DCount("*","orders","o_custkey=" & [c_custkey])', "n"), ('DMax("o_totalprice","orders","o_custkey=" & [c_custkey])', "top")]), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey=c_custkey) AS top FROM customer")

# stored SQL and action queries
add("stored_select_top", stored("SELECT TOP 5 [n_name], n_nationkey & \"!\" AS tag FROM [nation] WHERE n_regionkey = 1 ORDER BY n_name;"), "SELECT n_name, n_nationkey || '!' AS tag FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 5")
add("stored_union_all", stored("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier;"), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("stored_union", stored("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier;"), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("stored_crosstab", stored("TRANSFORM Count(*) AS n SELECT o_orderpriority FROM orders GROUP BY o_orderpriority PIVOT o_orderstatus IN ('F','O','P');"), "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus='F'),0) AS F, nullif(count(*) FILTER (o_orderstatus='O'),0) AS O, nullif(count(*) FILTER (o_orderstatus='P'),0) AS P FROM orders GROUP BY 1")
add("stored_insert", stored("INSERT INTO region (r_regionkey, r_name) SELECT n_nationkey+100, n_name FROM nation WHERE n_regionkey = 0;"), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey+100, n_name FROM nation WHERE n_regionkey=0")
add("stored_update", stored("UPDATE customer SET c_acctbal = c_acctbal + 100, c_mktsegment = 'X' WHERE c_acctbal < 0;"), "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal<0 THEN c_acctbal+100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal<0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
add("stored_delete", stored("DELETE * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000;"), "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")
add("stored_like", stored("SELECT n_name FROM nation WHERE n_name LIKE '*A*' AND n_name NOT LIKE '??I*';"), "SELECT n_name FROM nation WHERE n_name LIKE '%A%' AND n_name NOT LIKE '__I%'")
add("stored_like_subquery", stored("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '*A*') AND IIf(c_acctbal>0,1,0)=1;"), "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%') AND c_acctbal > 0")
add("stored_functions", stored("SELECT o.o_orderkey, IIf(o.o_totalprice>100000,'big','small') AS size, Nz(Switch(o.o_orderstatus='F','done'),'open') AS state, InStr(2,o.o_orderpriority,'-') AS dash, Mid(o.o_orderpriority,3,2) AS code, DateAdd('m',1,o.o_orderdate) AS due FROM orders AS o WHERE o.o_orderdate>=#1/1/1997#;"), "SELECT o_orderkey, CASE WHEN o_totalprice>100000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_orderstatus='F' THEN 'done' ELSE 'open' END AS state, CASE WHEN instr(substr(o_orderpriority,2),'-')=0 THEN 0 ELSE instr(substr(o_orderpriority,2),'-')+1 END AS dash, substr(o_orderpriority,3,2) AS code, o_orderdate + INTERVAL 1 MONTH AS due FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
add("stored_parameters", stored("PARAMETERS [least price] Double, [status] Text ( 1 ); SELECT o_orderkey FROM orders WHERE o_totalprice>[least price] AND o_orderstatus=[status];"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'", params={"least price": 150000, "status": "O"})
add("stored_join_group", stored("SELECT r.r_name, Count(*) AS n, Round(Sum(customer.c_acctbal),2) AS total FROM (region AS r INNER JOIN nation ON r.r_regionkey=nation.n_regionkey) LEFT JOIN customer ON nation.n_nationkey=customer.c_nationkey WHERE r.r_regionkey<4 GROUP BY r.r_name HAVING Count(*)>5 ORDER BY r.r_name DESC;"), "SELECT r_name, count(*) AS n, round(sum(c_acctbal),2) AS total FROM region JOIN nation ON r_regionkey=n_regionkey LEFT JOIN customer ON n_nationkey=c_nationkey WHERE r_regionkey<4 GROUP BY 1 HAVING count(*)>5 ORDER BY 1 DESC")
add("stored_from_subquery", stored("SELECT q.k, Max(q.v) AS top FROM (SELECT c_nationkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal>0) AS q GROUP BY q.k;"), "SELECT c_nationkey AS k, max(c_acctbal) AS top FROM customer WHERE c_acctbal > 0 GROUP BY 1")
add("stored_make_table", stored("SELECT c_custkey, c_name INTO rich FROM customer WHERE c_acctbal > 5000;"), "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
add("stored_insert_values", stored("INSERT INTO region (r_name, r_regionkey) VALUES ('NORTH, (far)', 2+5);"), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 7, 'NORTH, (far)'")
add("stored_update_literal", stored("UPDATE nation SET n_name = 'a, b', n_regionkey = n_regionkey + 1 WHERE n_name LIKE 'A*';"), "SELECT n_nationkey, CASE WHEN n_name LIKE 'A%' THEN 'a, b' ELSE n_name END AS n_name, CASE WHEN n_name LIKE 'A%' THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation")
add("stored_update_join", stored("UPDATE customer INNER JOIN nation ON customer.c_nationkey=nation.n_nationkey SET customer.c_mktsegment = nation.n_name, customer.c_acctbal = 0 WHERE nation.n_regionkey=1 AND customer.c_acctbal<0;"), "SELECT c_custkey, c_name, c_nationkey, CASE WHEN hit THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN hit THEN n_name ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, n_regionkey=1 AND c_acctbal<0 AS hit FROM customer JOIN nation ON c_nationkey=n_nationkey)")
add("stored_crosstab_join", stored("TRANSFORM Sum(o.o_totalprice) AS total SELECT c.c_mktsegment AS segment FROM customer AS c INNER JOIN orders AS o ON c.c_custkey=o.o_custkey WHERE o.o_totalprice>1000 GROUP BY c.c_mktsegment PIVOT Year(o.o_orderdate) IN (1996,1997);"), "SELECT c_mktsegment AS segment, sum(o_totalprice) FILTER (year(o_orderdate)=1996) AS \"1996\", sum(o_totalprice) FILTER (year(o_orderdate)=1997) AS \"1997\" FROM customer JOIN orders ON c_custkey=o_custkey WHERE o_totalprice>1000 GROUP BY 1")

# functions that the queries above leave out
expressions("expr_convert_more", "orders", ["o_orderkey"], [("i", "CInt(o_totalprice/1000)", "CAST(round_even(o_totalprice/1000,0) AS INTEGER)"), ("b", "CByte(o_orderkey Mod 200)", "CAST(o_orderkey % 200 AS INTEGER)"), ("f", "CSng(o_orderkey Mod 64)", "CAST(o_orderkey % 64 AS FLOAT)"), ("m", "CDec(o_orderkey)", "CAST(o_orderkey AS DECIMAL(28,10))"), ("v", "CVar(o_orderstatus)", "o_orderstatus"), ("s", "Str(o_orderkey)", "CAST(o_orderkey AS VARCHAR)"), ("d", 'CDate("2020-02-29 13:05:00")', "TIMESTAMP '2020-02-29 13:05:00'"), ("t", "TimeValue(o_orderdate)", "strftime(o_orderdate,'%H:%M:%S')"), ("e", "IsEmpty(o_orderstatus)", "o_orderstatus IS NULL")])
expressions("expr_clock_random", "region", ["r_regionkey"], [("d", 'DateDiff("d",Date(),Now())', "0"), ("t", "Len(Time())", "8"), ("r", "Rnd(7)>=0 And Rnd(7)<1", "true")])
add("domain_statistics", grid(["region"], ["region.r_regionkey", ('Round(DAvg("c_acctbal","customer"),4)', "a"), ('DMin("c_acctbal","customer","c_acctbal>0")', "b"), ('Round(DStDev("c_acctbal","customer"),4)', "s"), ('Round(DVar("c_acctbal","customer"),2)', "v")]), "SELECT r_regionkey, (SELECT round(avg(c_acctbal),4) FROM customer) AS a, (SELECT min(c_acctbal) FROM customer WHERE c_acctbal>0) AS b, (SELECT round(stddev_samp(c_acctbal),4) FROM customer) AS s, (SELECT round(var_samp(c_acctbal),2) FROM customer) AS v FROM region")
add("domain_first_last", grid(["events"], ["events.event_id", ('DFirst("value","events")', "a"), ('DLast("value","events")', "b")]), "SELECT event_id, (SELECT arg_min(value, event_id) FROM events) AS a, (SELECT arg_max(value, event_id) FROM events) AS b FROM events", order="event_id")
add("domain_correlated_many", grid(["customer"], ["customer.c_custkey", ('DCount("*","orders","o_custkey=" & [c_custkey] & " And o_orderstatus=\'" & Left([c_mktsegment],1) & "\'")', "n"), ('DSum("o_totalprice","orders","o_custkey=" & [c_custkey] & " And o_totalprice>" & [c_acctbal]*20)', "total")]), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey AND o_orderstatus=left(c_mktsegment,1)) AS n, (SELECT sum(o_totalprice) FROM orders WHERE o_custkey=c_custkey AND o_totalprice>c_acctbal*20) AS total FROM customer")
expressions("expr_whole_division", "lineitem", _LK, [("q", "(l_quantity+0.5)\\7", "CAST(round_even(l_quantity+0.5,0) AS BIGINT) // 7"), ("m", "(l_quantity+0.5) Mod 7", "CAST(round_even(l_quantity+0.5,0) AS BIGINT) % 7"), ("z", "l_orderkey\\(l_linenumber-1)", "l_orderkey // nullif(l_linenumber-1,0)"), ("big", "(9007199254740993+l_linenumber)\\1", "9007199254740993+l_linenumber")])
expressions("expr_is_kinds", "region", ["r_regionkey"], [("a", "IsError(r_name)", "false"), ("b", "IsObject(r_name)", "false"), ("c", "IsArray(r_name)", "false")])

# patterns with digits, classes and backslashes, written and computed
add("like_classes", grid(["nation"], ["nation.n_nationkey"], where="nation.n_name Like '*[0-3]' Or nation.n_name Like '[!N]*' Or nation.n_name Like '*[_]#[57]'"), "SELECT n_nationkey FROM nation WHERE regexp_full_match(n_name, '.*[0-3]') OR regexp_full_match(n_name, '[^N].*') OR regexp_full_match(n_name, '.*[_][0-9][57]')")
add("like_backslash", grid(["nation"], ["nation.n_nationkey", ("IIf(('C:\\' & [n_regionkey] & '%') Like 'C:\\#%',1,0)", "a"), ("IIf(('C:\\d' & [n_regionkey]) Like 'C:\\[d-f]*',1,0)", "b"), ("IIf('C:x' Like 'C:\\*',1,0)", "c")]), "SELECT n_nationkey, 1 AS a, 1 AS b, 0 AS c FROM nation")
add("like_computed", grid(["nation"], ["nation.n_nationkey"], where="('x\\' & nation.n_nationkey) Like ('[w-y]\\*' & Right(nation.n_name,1)) And ('a' & nation.n_regionkey) Like ('[!' & Chr(98) & ']#')"), "SELECT n_nationkey FROM nation WHERE right(CAST(n_nationkey AS VARCHAR),1) = right(n_name,1)")

# subqueries inside expressions, with the dialect's operators in and around them
add("stored_in_subquery", stored("SELECT c_custkey FROM customer WHERE (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey ^ 2 = 4)) AND c_acctbal \\ 1000 > 1;"), "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND CAST(round_even(c_acctbal,0) AS BIGINT) // 1000 > 1")
add("stored_in_or", stored("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) XOR c_acctbal < 0;"), "SELECT c_custkey FROM customer WHERE (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) <> (c_acctbal < 0)")
add("stored_in_correlated", stored("SELECT o.o_orderkey FROM orders AS o WHERE o.o_totalprice IN (SELECT Max(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey);"), "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
add("stored_exists", stored("SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40) AND NOT EXISTS (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey Mod 2 = 1);"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey % 2 = 1)")
add("stored_exists_self", stored("SELECT n_nationkey, EXISTS (SELECT * FROM nation AS b WHERE b.n_regionkey = nation.n_regionkey AND b.n_nationkey > nation.n_nationkey + 10) AS later FROM nation WHERE NOT EXISTS (SELECT * FROM nation AS b WHERE b.n_regionkey = nation.n_regionkey AND b.n_nationkey < nation.n_nationkey);"), "SELECT n_nationkey, EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey + 10) AS later FROM nation a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey)")
add("stored_scalar_subquery", stored("SELECT n_name, (SELECT Count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS poor, (SELECT Max(c_acctbal) FROM customer) AS top, Nz((SELECT Round(Sum(c_acctbal),2) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900),0)+1 AS least FROM nation;"), "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS poor, (SELECT max(c_acctbal) FROM customer) AS top, coalesce((SELECT round(sum(c_acctbal),2) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900),0)+1 AS least FROM nation")
add("stored_not_in_nulls", stored("SELECT n_nationkey, IIf(n_nationkey NOT IN (SELECT IIf(s_suppkey>50,s_nationkey,Null) FROM supplier),1,0) AS a, IIf(n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 5),1,0) AS b, IIf(Null NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0),1,0) AS c FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey Between 3 And 7);"), "SELECT n_nationkey, CASE WHEN n_nationkey NOT IN (SELECT CASE WHEN s_suppkey>50 THEN s_nationkey END FROM supplier) THEN 1 ELSE 0 END AS a, CASE WHEN n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 5) THEN 1 ELSE 0 END AS b, 1 AS c FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey BETWEEN 3 AND 7)")
add("stored_quantified", stored("SELECT c_custkey, IIf(c_acctbal >= ALL (SELECT b.c_acctbal FROM customer AS b WHERE b.c_nationkey = customer.c_nationkey),1,0) AS top, IIf(c_custkey < ANY (SELECT s_suppkey FROM supplier WHERE s_nationkey = c_nationkey),1,0) AS low, IIf(c_nationkey <> ALL (SELECT s_nationkey FROM supplier WHERE s_nationkey > 12),1,0) AS other FROM customer;"), "SELECT c_custkey, CASE WHEN c_acctbal >= ALL (SELECT b.c_acctbal FROM customer b WHERE b.c_nationkey = a.c_nationkey) THEN 1 ELSE 0 END AS top, CASE WHEN c_custkey < ANY (SELECT s_suppkey FROM supplier WHERE s_nationkey = c_nationkey) THEN 1 ELSE 0 END AS low, CASE WHEN c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 12) THEN 1 ELSE 0 END AS other FROM customer a")
add("stored_nested_subquery", stored("SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > (SELECT Avg(i.o_totalprice)*1.5 FROM orders AS i WHERE i.o_orderstatus = orders.o_orderstatus) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49));"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND o_totalprice > (SELECT avg(i.o_totalprice)*1.5 FROM orders i WHERE i.o_orderstatus = o.o_orderstatus) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))")
add("stored_having_subquery", stored("SELECT c_nationkey, Count(*) AS n FROM customer GROUP BY c_nationkey HAVING Count(*) > (SELECT Count(*)/25 FROM customer) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0);"), "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > (SELECT count(*)/25 FROM customer) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
add("stored_delete_in", stored("DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal \\ 100 < 20) OR o_totalprice < (SELECT Avg(o_totalprice)/4 FROM orders);"), "SELECT * FROM orders WHERE NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE CAST(round_even(c_acctbal,0) AS BIGINT) // 100 < 20) OR o_totalprice < (SELECT avg(o_totalprice)/4 FROM orders))")
add("stored_update_subquery", stored("UPDATE nation SET n_regionkey = (SELECT Count(*) FROM customer WHERE c_nationkey = n_nationkey) WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20);"), "SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20) THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) ELSE n_regionkey END AS n_regionkey FROM nation")

# action queries over joins, and the rest of SELECT
add("stored_delete_join", stored("DELETE orders.* FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_acctbal < 0 AND orders.o_orderstatus <> 'F';"), "SELECT * FROM orders WHERE NOT (o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
add("stored_delete_second", stored("DELETE c.* FROM nation AS n INNER JOIN customer AS c ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 3;"), "SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
add("stored_update_self", stored("UPDATE nation AS a INNER JOIN nation AS b ON a.n_nationkey = b.n_nationkey + 1 SET a.n_name = b.n_name WHERE b.n_regionkey = a.n_regionkey Or b.n_nationkey Mod 2 = 0;"), "SELECT a.n_nationkey, CASE WHEN b.n_nationkey IS NOT NULL AND (b.n_regionkey = a.n_regionkey OR b.n_nationkey % 2 = 0) THEN b.n_name ELSE a.n_name END AS n_name, a.n_regionkey FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_nationkey + 1")
add("stored_star_last", stored("SELECT n_nationkey * 2 AS twice, *, n_name & '!' AS loud FROM nation;"), "SELECT n_nationkey * 2 AS twice, nation.*, n_name || '!' AS loud FROM nation")
add("stored_top_percent", stored("SELECT TOP 7.5 PERCENT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey;"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= ceil(count(*) OVER () * 7.5 / 100)")
add("stored_crosstab_order", stored("TRANSFORM Count(*) AS n SELECT o_orderpriority AS p FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderpriority ORDER BY o_orderpriority DESC PIVOT o_orderstatus IN ('F','O');"), "SELECT o_orderpriority AS p, nullif(count(*) FILTER (o_orderstatus='F'),0) AS \"F\", nullif(count(*) FILTER (o_orderstatus='O'),0) AS \"O\" FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1 ORDER BY 1 DESC")

# running domain aggregates: a range that ends at the row's value
add("domain_running_sum", grid(["orders"], ["orders.o_orderkey", ('DSum("CLng(o_totalprice*100)","orders","o_custkey=" & [o_custkey] & " And o_orderkey<=" & [o_orderkey])', "total"), ('DCount("*","orders","o_orderkey<" & [o_orderkey])', "before"), ('DMax("o_totalprice","orders","o_totalprice>100000 And o_custkey=" & [o_custkey] & " And o_orderkey>" & [o_orderkey])', "later"), ('Round(DAvg("CLng(o_totalprice*100)","orders","o_totalprice>=" & [o_totalprice]),1)', "mean")]), "SELECT o_orderkey, CAST(sum(CAST(round_even(o_totalprice*100,0) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS before, max(CASE WHEN o_totalprice>100000 THEN o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, round(avg(CAST(round_even(o_totalprice*100,0) AS BIGINT)) OVER (ORDER BY o_totalprice DESC RANGE UNBOUNDED PRECEDING),1) AS mean FROM orders")
expressions("expr_is_error", "lineitem", _LK, [("a", "IsError(l_quantity/(l_linenumber-1))", "l_linenumber = 1"), ("b", "IsError(CLng(IIf(l_linenumber=2,'x','5')) & CDate(l_returnflag))", "true"), ("c", "IsError(Log(l_linenumber-3)+1)", "l_linenumber <= 3"), ("d", "IsError(l_quantity Mod (l_linenumber-2)/10)", "l_linenumber <= 7"), ("e", "IsError(CDbl(l_discount))", "false")])
expressions("expr_is_array", "embeddings", ["vec_id"], [("a", "IsArray(embedding)", "embedding IS NOT NULL"), ("b", "IsArray(label)", "false"), ("c", "IsObject(embedding)", "false")])
