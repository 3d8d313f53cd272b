"""Registered queries of schemas, macros, forms, coverage, graphs and streams over the driver tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.catalogue import register
from gridspark.checkpoints import shared_path
from gridspark.operators import cascades, constraints, coverage, datamacros, graph, names, screens, triggers
from gridspark.plans import scripts
from gridspark.plans.execute import run_query
from gridspark.plans.tables import dealt, parquet_tables
from gridspark.sources import forms, packages, schema, vba
from gridspark.sources.macros import Handler, Statement, read_data_macros
from gridspark.sources.schema import Relationship
from gridspark.streaming import ingestion


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# schema rules
ORDERS_XSD = """<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:od="urn:schemas-microsoft-com:officedata">
<xsd:element name="orders"><xsd:annotation><xsd:appinfo>
<od:index index-name="PrimaryKey" index-key="o_orderkey " primary="yes" unique="yes"/></xsd:appinfo></xsd:annotation>
<xsd:complexType><xsd:sequence>
<xsd:element name="o_orderkey" od:jetType="longinteger" od:nonNullable="yes"/>
<xsd:element name="o_orderstatus" od:jetType="text"><xsd:annotation><xsd:appinfo>
<od:fieldProperty name="ValidationRule" value="In ('F','O')"/><od:fieldProperty name="AllowZeroLength" value="0"/></xsd:appinfo></xsd:annotation></xsd:element>
<xsd:element name="o_totalprice" od:jetType="currency"><xsd:annotation><xsd:appinfo>
<od:fieldProperty name="ValidationRule" value="&lt;200000 And [o_totalprice]&gt;1000"/></xsd:appinfo></xsd:annotation></xsd:element>
</xsd:sequence></xsd:complexType></xsd:element></xsd:schema>"""
_FK = schema.Relationship("fk", "orders", "customer", ["o_custkey"], ["c_custkey"], 0x1100)


@register("schema_check_violations", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity > 5)")
def _(spark, sf_dir):
    return constraints.check_violations(_t(spark, sf_dir, "lineitem"), "l_quantity", ">5").select("l_orderkey", "l_linenumber", "l_quantity")


@register("schema_table_violations", "SELECT * FROM (SELECT 'check' AS \"constraint\", 'o_orderstatus' AS detail, count(*) FILTER (NOT o_orderstatus IN ('F','O')) AS rows FROM orders UNION ALL SELECT 'check', 'o_totalprice', count(*) FILTER (NOT (o_totalprice<200000 AND o_totalprice>1000)) FROM orders) WHERE rows > 0")
def _(spark, sf_dir):
    return constraints.table_violations(_t(spark, sf_dir, "orders"), schema.read_table(ORDERS_XSD, "orders"))


@register("schema_pk_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1,2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return constraints.duplicate_keys(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("schema_required", "SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c_nationkey = n_nationkey AND n_regionkey < 2 WHERE n.n_name IS NULL")
def _(spark, sf_dir):
    joined = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation").filter("n_regionkey < 2"), F.expr("c_nationkey = n_nationkey"), "left")
    return constraints.missing_values(joined, "n_name", allow_zero_length=False).select("c_custkey", "n_name")


@register("schema_defaults", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus='F' THEN NULL ELSE o_totalprice END, o_custkey*2+1) AS price FROM orders")
def _(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("CASE WHEN o_orderstatus='F' THEN NULL ELSE o_totalprice END").alias("price"))
    return constraints.with_defaults(rows, {"price": "[o_custkey]*2+1"}).select("o_orderkey", "price")


@register("fk_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf_dir):
    return constraints.orphans(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").filter("c_acctbal > 0"), _FK).select("o_orderkey")


@register("fk_join_path", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    return constraints.join_parent(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _FK).select("o_orderkey", "c_name")


@register("fk_cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, sf_dir):
    return constraints.cascade_delete(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").filter("c_acctbal < 0"), _FK).select("o_orderkey")


@register("fk_cascade_update", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def _(spark, sf_dir):
    changes = _t(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return constraints.cascade_update(_t(spark, sf_dir, "orders"), changes, _FK).select("o_orderkey", "o_custkey")


@register("lookup_row_source", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    return constraints.with_lookup(_t(spark, sf_dir, "customer"), "c_nationkey", _t(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@register("fk_cascade_update_composite", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 AND l_suppkey % 2 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS l_partkey, CASE WHEN l_partkey % 10 = 0 AND l_suppkey % 2 = 0 THEN -l_suppkey ELSE l_suppkey END AS l_suppkey FROM lineitem")
def _(spark, sf_dir):
    two = schema.Relationship("fk2", "lineitem", "offers", ["l_partkey", "l_suppkey"], ["p", "s"], 0x1100)
    lines = _t(spark, sf_dir, "lineitem")
    keys = lines.filter("l_partkey % 10 = 0 and l_suppkey % 2 = 0").select("l_partkey", "l_suppkey").distinct()
    changes = keys.select(F.struct("l_partkey", "l_suppkey").alias("old"), F.struct((F.col("l_partkey") + 1000000).alias("p"), (-F.col("l_suppkey")).alias("s")).alias("new"))
    return constraints.cascade_update(lines, changes, two).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("lookup_repeated_bound", "SELECT n_nationkey, (SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey) AS someone FROM nation")
def _(spark, sf_dir):
    return constraints.with_lookup(_t(spark, sf_dir, "nation"), "n_nationkey", _t(spark, sf_dir, "customer"), "c_nationkey", "c_name", "someone").select("n_nationkey", "someone")


# forms and reports
FORM = """Begin Form
    RecordSource ="orders"
    Filter ="[o_totalprice]>150000"
    FilterOn =-1
    OnLoad ="[Event Procedure]"
    OnCurrent ="mcrRefresh"
    Begin
        Begin Label
        End
        Begin Section
            Name ="Detail"
            Begin
                Begin TextBox
                    Name ="txtNet"
                    ControlSource ="=Round([o_totalprice]*0.9,1)"
                End
                Begin ComboBox
                    Name ="cboNation"
                    ControlSource ="o_custkey"
                    RowSourceType ="Table/Query"
                    RowSource ="SELECT c_custkey FROM customer"
                    AfterUpdate ="[Event Procedure]"
                End
                Begin Subform
                    Name ="subLines"
                    SourceObject ="Form.lineitem"
                    LinkChildFields ="l_orderkey"
                    LinkMasterFields ="o_orderkey"
                End
            End
        End
    End
End
"""


@register("form_calculated_control", "SELECT o_orderkey, round(o_totalprice*0.9,1) AS txtNet FROM orders WHERE o_totalprice > 150000")
def _(spark, sf_dir):
    from gridspark.functions.columns import compile_expression, frame_context

    model = forms.read_form(FORM, "frmOrders")
    df = _t(spark, sf_dir, model.record_source)
    context = frame_context(dict(df.dtypes))
    if model.filter_on:
        df = df.filter(compile_expression(model.filter, context))
    made = [compile_expression(b.source, context).alias(c.name) for c in model.controls for b in c.bindings if b.kind == "calculated"]
    return df.select("o_orderkey", *made)


@register("subform_link", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(spark, sf_dir):
    binding = next(b for c in forms.read_form(FORM, "frmOrders").controls for b in c.bindings if b.kind == "subform")
    master, child = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, binding.source.removeprefix("Form."))
    on = [master[m] == child[c] for m, c in zip(binding.link_master, binding.link_child, strict=True)]
    return master.join(child, on).select("o_orderkey", "l_linenumber", "l_quantity")


@register("report_group_levels", "SELECT n_regionkey, c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY ROLLUP(n_regionkey, c_mktsegment)")
def _(spark, sf_dir):
    report = forms.read_form('Begin Report\n RecordSource ="q"\n Begin\n  Begin BreakLevel\n   ControlSource ="n_regionkey"\n  End\n  Begin BreakLevel\n   ControlSource ="c_mktsegment"\n  End\n End\nEnd\n', "rpt", "report")
    df = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return df.rollup(*[g.source for g in report.group_levels]).agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("top"))


@register("form_filter_order", "SELECT o_orderkey, o_totalprice, round(o_totalprice*0.9,1) AS \"txtNet\" FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey")
def _(spark, sf_dir):
    """A form over stored SQL, with filter, order and calculated control."""
    text = FORM.replace('RecordSource ="orders"', 'RecordSource ="SELECT * FROM orders WHERE o_orderstatus<>\'P\'"').replace("FilterOn =-1", 'FilterOn =-1\n    OrderBy ="[o_totalprice] DESC, o_orderkey"\n    OrderByOn =-1')
    model = forms.read_form(text, "frmOrders")
    rows = screens.form_rows(model, parquet_tables(spark, sf_dir))
    return rows.select("o_orderkey", "o_totalprice", *[c for c, n in zip(screens.control_columns(model, rows), ["txtNet", "cboNation"], strict=True) if n == "txtNet"])


@register("report_group_on", "SELECT date_trunc('year', o_orderdate) AS group_0, left(o_orderpriority, 1) AS group_1, CAST(floor(o_totalprice / 100000) * 100000 AS BIGINT) AS group_2, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ROLLUP(1, 2, 3)")
def _(spark, sf_dir):
    """Group levels by year (latest first), by the first letter and by intervals."""
    level = lambda source, on, step, down: f"  Begin BreakLevel\n   ControlSource =\"{source}\"\n   GroupOn ={on}\n   GroupInterval ={step}\n   SortOrder ={down}\n  End\n"
    text = 'Begin Report\n RecordSource ="orders"\n Begin\n' + level("o_orderdate", 2, 1, 1) + level("o_orderpriority", 1, 1, 0) + level("o_totalprice", 9, 100000, 0) + " End\nEnd\n"
    model = forms.read_form(text, "rptOrders", "report")
    return screens.report_groups(model, screens.form_rows(model, parquet_tables(spark, sf_dir)), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@register("value_list_rows", "SELECT * FROM (VALUES (0, 'F', 'finished; all'), (1, 'O', 'open'), (2, 'P', NULL)) t(ordinal, column_0, column_1)")
def _(spark, sf_dir):
    return screens.value_list(spark, '"F";"finished; all";O;open;"P"', 2)


# data macros
_AXL = 'xmlns="http://schemas.microsoft.com/office/accessservices/2009/11/application"'
BEFORE_CHANGE = f"""<DataMacros {_AXL}><DataMacro Event="BeforeChange"><Statements>
<ConditionalBlock>
<If><Condition>[o_totalprice]&gt;200000</Condition><Statements><Action Name="SetField"><Argument Name="Field">o_orderpriority</Argument><Argument Name="Value">"0-TOP"</Argument></Action></Statements></If>
<ElseIf><Condition>[o_orderstatus]="P"</Condition><Statements><Action Name="SetField"><Argument Name="Field">o_orderpriority</Argument><Argument Name="Value">"9-WAIT"</Argument></Action></Statements></ElseIf>
<Else><Statements><Action Name="SetField"><Argument Name="Field">o_totalprice</Argument><Argument Name="Value">[o_totalprice]+1</Argument></Action></Statements></Else>
</ConditionalBlock></Statements></DataMacro></DataMacros>"""


@register("macro_before_change", "SELECT o_orderkey, CASE WHEN o_totalprice>200000 OR o_orderstatus='P' THEN o_totalprice ELSE o_totalprice+1 END AS o_totalprice, CASE WHEN o_totalprice>200000 THEN '0-TOP' WHEN o_orderstatus='P' THEN '9-WAIT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(spark, sf_dir):
    handler = read_data_macros(BEFORE_CHANGE, "orders").handlers[0]
    return datamacros.run_handler(handler, _t(spark, sf_dir, "orders"), parquet_tables(spark, sf_dir)).rows.select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("macro_lookup_record", "SELECT c_custkey, coalesce((SELECT n_name FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1), c_mktsegment) AS c_mktsegment FROM customer")
def _(spark, sf_dir):
    look = Statement("block", "LookUpRecord", {"Reference": "nation", "Alias": "n", "WhereCondition": "[n].[n_nationkey]=[c_nationkey] And [n].[n_regionkey]=1"}, statements=[Statement("action", "SetField", {"Field": "c_mktsegment", "Value": "Nz([n].[n_name],[c_mktsegment])"})])
    return datamacros.run_handler(Handler("AfterUpdate", [look]), _t(spark, sf_dir, "customer"), parquet_tables(spark, sf_dir)).rows.select("c_custkey", "c_mktsegment")


@register("macro_for_each", "SELECT r_regionkey, n_name AS r_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    loop = Statement("block", "ForEachRecord", {"Reference": "nation", "Alias": "n", "WhereCondition": "[n].[n_regionkey]=[r_regionkey]"}, statements=[Statement("block", "CreateRecord", {"Reference": "region"}, statements=[Statement("action", "SetField", {"Field": "r_regionkey", "Value": "[r_regionkey]"}), Statement("action", "SetField", {"Field": "r_name", "Value": "[n].[n_name]"})])])
    return datamacros.run_handler(Handler("AfterInsert", [loop]), _t(spark, sf_dir, "region"), parquet_tables(spark, sf_dir)).created["region"]


@register("macro_delete_record", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value < 50)")
def _(spark, sf_dir):
    block = Statement("conditional", branches=[("if", "[event_type]='error' And [value]<50", [Statement("action", "DeleteRecord")])])
    return datamacros.run_handler(Handler("AfterInsert", [block]), _t(spark, sf_dir, "events"), parquet_tables(spark, sf_dir)).rows.select("event_id")


@register("macro_raise_error", "SELECT event_id, 'too large' AS error FROM events WHERE value > 90")
def _(spark, sf_dir):
    block = Statement("conditional", branches=[("if", "[value]>90", [Statement("action", "RaiseError", {"Error Description": "too large"})])])
    return datamacros.run_handler(Handler("BeforeChange", [block]), _t(spark, sf_dir, "events"), parquet_tables(spark, sf_dir)).errors.select("event_id", "error")


def _set(column: str, value: str) -> Statement:
    return Statement("action", "SetField", {"Field": column, "Value": value})


def _if(condition: str, *statements: Statement) -> Statement:
    return Statement("conditional", branches=[("if", condition, list(statements))])


def _each(*statements: Statement, where: str = "[n].[n_regionkey]=[r_regionkey]", kind: str = "ForEachRecord") -> Statement:
    return Statement("block", kind, {"Reference": "nation", "Alias": "n", "WhereCondition": where}, statements=list(statements))


_NOTE = Statement("block", "CreateRecord", {"Reference": "region"}, statements=[_set("r_regionkey", "[n].[n_nationkey]"), _set("r_name", "[n].[n_name]")])


@register("macro_for_each_rows", "SELECT r_regionkey, r_name || '!' AS r_name FROM region")
def _(spark, sf_dir):
    """The firing rows are the same rows after a loop over some of them."""
    handler = Handler("AfterInsert", [_if("[r_regionkey]<2", _each(_NOTE)), _set("r_name", '[r_name] & "!"')])
    return datamacros.run_handler(handler, _t(spark, sf_dir, "region"), parquet_tables(spark, sf_dir)).rows


@register("macro_exit_loop", "SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey=a.n_regionkey AND b.n_nationkey<=a.n_nationkey AND b.n_nationkey>9)")
def _(spark, sf_dir):
    """Each region's nations in their order, up to the first with a key over 9."""
    loop = _each(_if("[n].[n_nationkey]>9", Statement("action", "ExitForEachRecord")), _NOTE)
    return datamacros.run_handler(Handler("AfterInsert", [loop]), _t(spark, sf_dir, "region"), parquet_tables(spark, sf_dir)).created["region"]


@register("macro_stop", "SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN o_orderpriority WHEN o_totalprice>100000 THEN 'big' ELSE 'rest' END AS o_orderpriority FROM orders")
def _(spark, sf_dir):
    handler = Handler("BeforeChange", [_if("[o_orderstatus]='F'", Statement("action", "StopMacro")), _set("o_orderpriority", '"rest"'), _if("[o_totalprice]>100000", _set("o_orderpriority", '"big"'), Statement("action", "StopAllMacros")), _set("o_orderpriority", '"rest"')])
    return datamacros.run_handler(handler, _t(spark, sf_dir, "orders"), parquet_tables(spark, sf_dir)).rows.select("o_orderkey", "o_orderpriority")


@register("macro_edit_record", "SELECT n_nationkey, CASE WHEN n_regionkey IN (1,2) AND n_nationkey>5 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey=r_regionkey")
def _(spark, sf_dir):
    """A loop that edits the records it visits."""
    edit = Statement("block", "EditRecord", statements=[_set("n_name", "[r_name]")])
    loop = _each(_if("[n].[n_nationkey]>5", edit))
    return datamacros.run_handler(Handler("AfterUpdate", [_if("[r_regionkey]=1 Or [r_regionkey]=2", loop)]), _t(spark, sf_dir, "region"), parquet_tables(spark, sf_dir)).edited["nation"]


@register("macro_edit_lookup", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal>9000) THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(spark, sf_dir):
    look = _each(Statement("block", "EditRecord", statements=[_set("n_regionkey", "99")]), where="[n].[n_nationkey]=[c_nationkey]", kind="LookUpRecord")
    return datamacros.run_handler(Handler("AfterUpdate", [_if("[c_acctbal]>9000", look)]), _t(spark, sf_dir, "customer"), parquet_tables(spark, sf_dir)).edited["nation"]


@register("macro_delete_twice", "SELECT event_id FROM events WHERE event_type IN ('error','click') AND value < 50")
def _(spark, sf_dir):
    gone = Statement("action", "DeleteRecord")
    handler = Handler("AfterInsert", [_if("[event_type]='error' And [value]<50", gone), _if("[event_type]='click' And [value]<50", gone)])
    return datamacros.run_handler(handler, _t(spark, sf_dir, "events"), parquet_tables(spark, sf_dir)).deleted["self"].select("event_id")


@register("macro_delete_looked_up", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey=3 AND n_nationkey>8")
def _(spark, sf_dir):
    loop = _each(_if("[n].[n_nationkey]>8", Statement("action", "DeleteRecord")))
    return datamacros.run_handler(Handler("AfterDelete", [_if("[r_regionkey]=3", loop)]), _t(spark, sf_dir, "region"), parquet_tables(spark, sf_dir)).deleted["nation"]


# names
@register("normalize_identifier", "SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(p_name || ' - ' || p_brand || '__x ', '[\\s-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')), '_+', '_', 'g'), '_') AS id FROM part")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", names.normalized(F.concat("p_name", F.lit(" - "), "p_brand", F.lit("__x "))).alias("id"))


# coverage: orders stand for units; the priority is the stage, the status the status
_UNITS = """SELECT CASE WHEN o_orderpriority < '3' THEN 'discovery' WHEN o_orderpriority < '5' THEN 'extraction' ELSE 'translation' END AS stage,
 CASE WHEN o_orderstatus='F' THEN 'complete' WHEN o_orderstatus='O' THEN CASE WHEN o_orderkey%3=0 THEN 'failed' ELSE 'partial' END ELSE 'not_applicable' END AS status,
 CAST(o_orderkey%5+1 AS BIGINT) AS weight, CAST(o_custkey%7 AS VARCHAR) AS sample_id, CAST(o_custkey%3 AS VARCHAR) AS kind,
 CASE WHEN o_orderstatus<>'F' THEN 'CODE_' || CAST(o_custkey%4 AS VARCHAR) END AS reason_code, o_orderkey AS ordinal, CAST(o_custkey AS VARCHAR) AS object FROM orders"""
_COUNTS = "CAST(sum(weight) AS BIGINT) AS units, " + ", ".join(f"CAST(sum(CASE WHEN status='{s}' THEN weight ELSE 0 END) AS BIGINT) AS {s}" for s in coverage.STATUSES)
_COVERED = "SELECT *, units - not_applicable AS eligible, CASE WHEN units>not_applicable THEN round(complete/(units-not_applicable)*100,2) ELSE 0.0 END AS completion_percentage FROM (SELECT {keys}, " + _COUNTS + f" FROM ({_UNITS}) GROUP BY {{group}})"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _UNITS.replace("AS VARCHAR", "AS STRING").replace("FROM orders", "FROM {orders}")
    return spark.sql(text, orders=_t(spark, sf_dir, "orders"))


@register("coverage_by_stage", _COVERED.format(keys="stage", group="stage"))
def _(spark, sf_dir):
    return coverage.coverage(_units(spark, sf_dir))


@register("coverage_scopes", _COVERED.format(keys="sample_id, kind, stage", group="GROUPING SETS ((sample_id, kind, stage), (sample_id, stage), (kind, stage), (stage))"))
def _(spark, sf_dir):
    return coverage.coverage_scopes(_units(spark, sf_dir), [["sample_id", "kind"], ["sample_id"], ["kind"], []])


@register("coverage_reason_weights", f"SELECT stage, reason_code, CAST(sum(weight) AS BIGINT) AS weight FROM ({_UNITS}) WHERE reason_code IS NOT NULL GROUP BY 1,2")
def _(spark, sf_dir):
    return coverage.reason_weights(_units(spark, sf_dir))


@register("reason_index", f"WITH f AS (SELECT reason_code, object, min(ordinal) AS o FROM ({_UNITS}) WHERE reason_code IS NOT NULL GROUP BY 1,2) SELECT reason_code, count(*) AS objects, array_to_string((list(object ORDER BY o, object))[1:8], ',') AS examples FROM f GROUP BY 1")
def _(spark, sf_dir):
    found = coverage.reason_index(_units(spark, sf_dir).filter("reason_code is not null"))
    return found.withColumn("examples", F.array_join("examples", ","))


_CODES = ("EXPRESSION_PARSE_FAILED", "MACRO_ACTION_UI_NOT_TRANSLATABLE", "LIKE_WILDCARD_DIALECT", "JOIN_FLAG_NOT_MAPPED")
_CODE_SQL = "CASE o_custkey%4 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
_OBJECTS = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS object, CASE o_custkey%2 WHEN 0 THEN 'data_logic' ELSE 'structure' END AS aspect, o_custkey%3<>0 AS has_content FROM orders"
_VERDICT = f"""SELECT o.object, o.aspect, CASE WHEN f.object IS NULL THEN 'complete' WHEN has_content THEN 'partial' ELSE 'failed' END AS status FROM ({_OBJECTS}) o
 LEFT JOIN (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS object, CASE o_custkey%4 WHEN 0 THEN 'data_logic' WHEN 1 THEN 'application_logic' WHEN 3 THEN 'structure' END AS aspect FROM orders WHERE o_custkey%4<>2 AND o_orderstatus<>'F') f
 ON o.object = f.object AND o.aspect = f.aspect"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    objects = spark.sql(_OBJECTS.replace("AS VARCHAR", "AS STRING").replace("FROM orders", "FROM {orders}"), orders=orders)
    findings = orders.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").cast("string").alias("object"), F.expr(_CODE_SQL).alias("reason_code"))
    return coverage.verdicts(objects, findings)


@register("aspect_verdicts", _VERDICT)
def _(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@register("aspect_totals", f"SELECT aspect, complete, partial, failed, complete+partial+failed AS scored, round(complete/(complete+partial+failed)*100,2) AS completion_percentage FROM (SELECT aspect, count(*) FILTER (status='complete') AS complete, count(*) FILTER (status='partial') AS partial, count(*) FILTER (status='failed') AS failed FROM ({_VERDICT}) GROUP BY 1)")
def _(spark, sf_dir):
    return coverage.aspect_totals(_verdicts(spark, sf_dir))


_FEATURE_OBJECTS = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS object, CASE WHEN o_custkey%5=0 THEN 'query:hidden_query' ELSE CASE o_custkey%2 WHEN 0 THEN 'form' ELSE 'query' END END AS feature, CASE o_custkey%7 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'not_started' WHEN 4 THEN 'failed' ELSE 'complete' END AS status FROM orders"
_OF = ", ".join(f"count(*) FILTER (status='{s}') AS {s}" for s in coverage.STATUSES if s != "not_applicable")


def _feature_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "CASE o_custkey%7 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'not_started' WHEN 4 THEN 'failed' ELSE 'complete' END"
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("object"), F.expr("CASE WHEN o_custkey%5=0 THEN 'query' WHEN o_custkey%2=0 THEN 'form' ELSE 'query' END").alias("kind"), F.expr("CASE WHEN o_custkey%5=0 THEN 'hidden_query' END").alias("subtype"), F.expr(status).alias("status")).distinct()


@register(
    "feature_rollup",
    f"""WITH o AS ({_FEATURE_OBJECTS}),
 c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS object, {_CODE_SQL} AS code FROM orders WHERE o_orderstatus='P' AND o_custkey%4<>2),
 n AS (SELECT feature, code, count(*) AS n FROM o JOIN c USING (object) GROUP BY 1,2)
 SELECT o.feature, count(*) AS objects, {_OF}, round(count(*) FILTER (status='complete')/count(*)*100,2) AS completion_percentage, coalesce(max(l.codes),'') AS blocking_codes FROM o LEFT JOIN (SELECT feature, string_agg(code, ',' ORDER BY -n, code) AS codes FROM n GROUP BY 1) l ON o.feature = l.feature GROUP BY 1""",
)
def _(spark, sf_dir):
    codes = _t(spark, sf_dir, "orders").filter("o_orderstatus='P'").select(F.col("o_custkey").cast("string").alias("object"), F.expr(_CODE_SQL).alias("reason_code"))
    return coverage.feature_rollup(_feature_objects(spark, sf_dir), codes)


@register("feature_aspects", f"WITH o AS ({_FEATURE_OBJECTS}), v AS ({_VERDICT}) SELECT feature, aspect, count(*) FILTER (v.status='complete') AS complete, count(*) FILTER (v.status='partial') AS partial, count(*) FILTER (v.status='failed') AS failed, count(*) FILTER (v.status='not_applicable') AS not_applicable FROM o JOIN v ON o.object = v.object GROUP BY 1, 2")
def _(spark, sf_dir):
    return coverage.feature_aspects(_feature_objects(spark, sf_dir), _verdicts(spark, sf_dir))


@register("reconcile_declared", "WITH d AS (SELECT o_orderkey AS k, CAST(o_orderkey%6 AS BIGINT) AS declared FROM orders), n AS (SELECT l_orderkey AS k, count(*) AS named FROM lineitem GROUP BY 1) SELECT coalesce(d.k,n.k) AS k, coalesce(declared,0) AS declared, coalesce(named,0) AS named, coalesce(declared,0)-coalesce(named,0) AS residual, coalesce(declared,0)<coalesce(named,0) AS over_named FROM d FULL JOIN n ON d.k=n.k")
def _(spark, sf_dir):
    declared = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 6).alias("declared"))
    named = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(1).cast("long").alias("weight"))
    return coverage.reconcile(declared, named, ["k"])


@register("action_census", "SELECT CASE user_id%3 WHEN 0 THEN 'data' WHEN 1 THEN 'ui' ELSE 'system' END AS category, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actions FROM events GROUP BY 1")
def _(spark, sf_dir):
    return coverage.census(_t(spark, sf_dir, "events").select(F.expr("CASE user_id%3 WHEN 0 THEN 'data' WHEN 1 THEN 'ui' ELSE 'system' END").alias("category"), F.col("event_type").alias("action")))


_STATEMENT = "CASE event_type WHEN 'view' THEN 'if' WHEN 'click' THEN 'for' WHEN 'error' THEN 'exit' WHEN 'signup' THEN 'goto' ELSE 'statement' END"


@register("procedure_metrics", f"SELECT proc, count(*) AS statements, CAST(sum(CASE WHEN type='if' THEN arms ELSE 0 END) AS BIGINT) AS branches, count(*) FILTER (type='for') AS loops, count(*) FILTER (type='exit') AS exits, count(*) FILTER (type='goto') AS gotos, CAST(0 AS BIGINT) AS labels, CAST(1+sum(CASE WHEN type='if' THEN arms ELSE 0 END)+count(*) FILTER (type='for') AS BIGINT) AS cyclomatic_complexity FROM (SELECT user_id AS proc, {_STATEMENT} AS type, CAST(event_id%3+1 AS BIGINT) AS arms FROM events) GROUP BY 1")
def _(spark, sf_dir):
    return coverage.procedure_metrics(_t(spark, sf_dir, "events").select(F.col("user_id").alias("proc"), F.expr(_STATEMENT).alias("type"), F.expr("event_id%3+1").alias("arms")))


# graphs: regions, nations, customers and suppliers as definitions
_NODES = "SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, 'table' AS kind FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, 'query' FROM nation UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name, CASE s_suppkey%2 WHEN 0 THEN 'form' ELSE 'report' END FROM supplier"
_EDGES = "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS src, 'r' || CAST(n_regionkey AS VARCHAR) AS dst FROM nation UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), 's' || CAST(s_suppkey+1 AS VARCHAR) FROM supplier WHERE s_suppkey%3=0"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views = {t: _t(spark, sf_dir, t) for t in ("region", "nation", "supplier")}

    def run(text):
        for t in views:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        return spark.sql(text.replace("AS VARCHAR", "AS STRING"), **{t: df for t, df in views.items() if f"{{{t}}}" in text})

    return run(_NODES), run(_EDGES)


@register("graph_entry_points", f"SELECT id, name, kind FROM ({_NODES}) n WHERE kind IN ('form','report') AND id NOT IN (SELECT dst FROM ({_EDGES}))")
def _(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    return graph.entry_points(nodes, links).select("id", "name", "kind")


@register("graph_neighbourhood", f"WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT b.dst, w.depth+1 FROM w JOIN b ON b.src=w.id WHERE w.depth<2) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def _(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    return graph.neighbourhood(links, nodes.filter("id = 'r1'"), 2)


@register("graph_layers", f"WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT id FROM ({_NODES})), w AS (SELECT id, 0 AS layer FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.layer+1 FROM w JOIN e ON e.src=w.id) SELECT id, max(layer) AS layer FROM w WHERE id IN (SELECT id FROM n) GROUP BY 1")
def _(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    kept = links.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return graph.layers(kept, nodes)


@register("graph_resolve", "WITH n AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'query' AS kind FROM nation UNION ALL SELECT 't' || CAST(n_nationkey AS VARCHAR), upper(n_name), 'table' FROM nation WHERE n_nationkey%2=0), r AS (SELECT s_suppkey AS src, n_name AS target, CASE s_suppkey%2 WHEN 0 THEN 'table' END AS hint FROM supplier JOIN nation ON s_nationkey=n_nationkey) SELECT src, id AS dst, 'reads' AS edge FROM (SELECT r.src, n.id, row_number() OVER (PARTITION BY r.src ORDER BY CASE WHEN n.kind=r.hint THEN 0 WHEN n.kind='query' THEN 1 ELSE 2 END) AS k FROM r JOIN n ON lower(r.target)=lower(n.name)) WHERE k=1")
def _(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    node = lambda p, kind, name: nation.select(F.concat(F.lit(p), F.col("n_nationkey").cast("string")).alias("id"), name.alias("name"), F.lit(kind).alias("kind"))
    nodes = node("n", "query", F.col("n_name")).unionByName(node("t", "table", F.upper("n_name")).filter("cast(substring(id, 2) as int) % 2 = 0"))
    refs = _t(spark, sf_dir, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select(F.col("s_suppkey").alias("src"), F.col("n_name").alias("target"), F.expr("CASE s_suppkey%2 WHEN 0 THEN 'table' END").alias("hint"), F.lit("reads").alias("edge"))
    return graph.resolve(refs, nodes)


@register("sql_source_extraction", "SELECT src, unnest(list_distinct(regexp_extract_all(text, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE)\\s+([A-Za-z_]\\w*)', 1))) AS target FROM (SELECT p_partkey AS src, 'SELECT * FROM ' || replace(p_brand,'#','_') || ' INNER JOIN ' || replace(p_type,' ','_') || ' ON 1=1' AS text FROM part)")
def _(spark, sf_dir):
    texts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.concat(F.lit("SELECT * FROM "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" INNER JOIN "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" ON 1=1")).alias("text"))
    return graph.read_tables(texts)


@register("graph_opened_objects", "SELECT p_partkey AS src, p_brand AS target, 'form' AS hint FROM part WHERE p_size % 2 = 0")
def _(spark, sf_dir):
    code = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.concat(F.expr("CASE p_size%2 WHEN 0 THEN '  DoCmd.OpenForm ' ELSE '  Debug.Print ' END"), F.lit('"'), "p_brand", F.lit('"')).alias("line"))
    return graph.opened_objects(code)


# corpora of definitions, made from the rows of a table
@register("expression_corpus", "SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'CASE WHEN p_size > ' || p_size || ' THEN 1 ELSE 0 END' WHEN p_size%3=1 THEN 'COALESCE(x' || p_size || ', 0)' ELSE 'NoSuchThing(' || p_size || ')' END AS sql, p_size%3<>2 AS translatable FROM part")
def _(spark, sf_dir):
    text = F.expr("CASE p_size%3 WHEN 0 THEN concat('IIf([p_size]>', p_size, ',1,0)') WHEN 1 THEN concat('Nz([x', p_size, '],0)') ELSE concat('NoSuchThing(', p_size, ')') END")
    return packages.expression_rows(_t(spark, sf_dir, "part").select("p_partkey", text.alias("source"))).select("p_partkey", "sql", "translatable")


@register("vba_metrics_corpus", "SELECT p_partkey, CAST(4+p_size%4 AS BIGINT) AS statements, CAST(2 AS BIGINT) AS branches, CAST(1 AS BIGINT) AS loops FROM part")
def _(spark, sf_dir):
    def work(batches):
        for batch in batches:
            rows = []
            for key, size in zip(batch["p_partkey"], batch["p_size"], strict=True):
                body = "".join(f"    x = {i}\n" for i in range(size % 4))
                m = vba.metrics(vba.read_module(f"Sub P{key}()\n  For i = 1 To {size}\n{body}    If i > 2 Then\n      y = 1\n    Else\n      y = 2\n    End If\n  Next i\nEnd Sub\n", "m").procedures[0])
                rows.append((key, m["statements"], m["branches"], m["loops"]))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["p_partkey", "statements", "branches", "loops"])

    return dealt(_t(spark, sf_dir, "part").select("p_partkey", "p_size")).mapInPandas(work, "p_partkey long, statements long, branches long, loops long")


# rates and event-time windows
@register("rate_limit_window", "SELECT event_id, user_id, in_window FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 1")
def _(spark, sf_dir):
    return ingestion.over_limit(_t(spark, sf_dir, "events"), "user_id", "ts", 1, 86400).select("event_id", "user_id", "in_window")


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def _(spark, sf_dir):
    return ingestion.windowed_counts(_t(spark, sf_dir, "events"), "ts", "event_type")


@register("stored_query_on_query", "SELECT n_regionkey, count(*) AS n FROM (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def _(spark, sf_dir):
    """A saved query that reads another one by name."""
    from gridspark.catalogue import grid

    base = parquet_tables(spark, sf_dir)
    inner = grid(["customer", "nation"], ["customer.c_custkey", "nation.n_regionkey"], joins=[("customer", "nation", "customer.c_nationkey=nation.n_nationkey", 1)])
    saved = {"qrycustomers": inner}
    tables = lambda name: run_query(saved[name.lower()], base) if name.lower() in saved else base(name)
    return run_query(grid(["qryCustomers"], ["qryCustomers.n_regionkey", ("Count(*)", "n")], groups=["qryCustomers.n_regionkey"]), tables)


_CHAIN = [
    Relationship("nation_region", "nation", "region", ["n_regionkey"], ["r_regionkey"], 4096 | 256),
    Relationship("customer_nation", "customer", "nation", ["c_nationkey"], ["n_nationkey"], 4096),
    Relationship("supplier_nation", "supplier", "nation", ["s_nationkey"], ["n_nationkey"], 4096),
    Relationship("orders_customer", "orders", "customer", ["o_custkey"], ["c_custkey"], 4096),
    Relationship("lineitem_orders", "lineitem", "orders", ["l_orderkey"], ["o_orderkey"], 4096),
    Relationship("lineitem_supplier", "lineitem", "supplier", ["l_suppkey"], ["s_suppkey"], 4096),
]


def _all_tables(spark, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "orders", "lineitem")}


_GONE = "SELECT n_nationkey FROM nation WHERE n_regionkey = 1"


@register("fk_cascade_chain", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN ({_GONE})) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN ({_GONE}))")
def _(spark, sf_dir):
    return cascades.delete_through(_all_tables(spark, sf_dir), _CHAIN, "region", "r_regionkey = 1").tables["lineitem"].select("l_orderkey", "l_linenumber")


@register("fk_cascade_blocked", f"SELECT c_custkey FROM customer WHERE c_nationkey IN ({_GONE})")
def _(spark, sf_dir):
    rules = [Relationship(r.name, r.child, r.parent, r.child_columns, r.parent_columns, 0) if r.name == "customer_nation" else r for r in _CHAIN]
    return cascades.delete_through(_all_tables(spark, sf_dir), rules, "region", "r_regionkey = 1").blocked["customer_nation"].select("c_custkey")


@register("fk_cascade_self", "WITH RECURSIVE d AS (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 7 UNION SELECT c.c_custkey FROM customer c JOIN d ON c.c_custkey // 3 = d.c_custkey AND c.c_custkey <> d.c_custkey) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM d)")
def _(spark, sf_dir):
    staff = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr("c_custkey div 3").alias("boss"))
    rule = Relationship("boss", "staff", "staff", ["boss"], ["c_custkey"], 4096)
    return cascades.delete_through({"staff": staff}, [rule], "staff", "c_custkey Mod 50 = 7").tables["staff"].select("c_custkey")


@register("fk_cascade_update_chain", "SELECT c_custkey, CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 ELSE n_regionkey END AS region, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    found = _all_tables(spark, sf_dir)
    found["customer"] = found["customer"].join(found["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"), "c_nationkey")
    rules = [_CHAIN[0], Relationship("customer_nation", "customer", "nation", ["region", "c_nationkey"], ["n_regionkey", "n_nationkey"], 256)]
    return cascades.change_keys(found, rules, "region", {"r_regionkey": "r_regionkey+100"}, "r_regionkey<2").tables["customer"]


def _local(name: str, value: str) -> Statement:
    return Statement("action", "SetLocalVar", {"Name": name, "Value": value})


def _orders_of(*statements: Statement, where: str = "[o].[o_custkey]=[c_custkey]") -> Statement:
    return Statement("block", "ForEachRecord", {"Reference": "orders", "Alias": "o", "WhereCondition": where}, statements=list(statements))


@register("macro_loop_sum", "SELECT c_custkey, coalesce((SELECT sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round_even(o_totalprice,0) AS BIGINT) WHEN o_orderkey % 2 = 0 THEN -c_nationkey ELSE 0 END) FROM orders WHERE o_custkey = c_custkey), 0) AS total, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def _(spark, sf_dir):
    branch = Statement("conditional", branches=[("if", "[o].[o_orderstatus]='F'", [_local("total", "[total]+CLng([o].[o_totalprice])")]), ("elseif", "[o].[o_orderkey] Mod 2=0", [_local("total", "[total]-[c_nationkey]")])])
    handler = Handler("AfterInsert", [_local("total", "CLng(0)"), _local("n", "CLng(0)"), _orders_of(branch, _local("n", "1+[n]")), Statement("action", "SetReturnVar", {"Name": "total", "Value": "[total]"}), Statement("action", "SetReturnVar", {"Name": "n", "Value": "[n]"})])
    return datamacros.run_handler(handler, _t(spark, sf_dir, "customer"), parquet_tables(spark, sf_dir)).rows.select("c_custkey", F.col("total").cast("long"), F.col("n").cast("long"))


@register("macro_loop_fold", "SELECT r_regionkey, coalesce((SELECT string_agg(n_name, ';' ORDER BY n_nationkey) FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE n_regionkey = r_regionkey AND i <= 3), '') AS r_name FROM region")
def _(spark, sf_dir):
    """A text that grows, until three names are in it."""
    sep = _set("r_name", '[r_name] & IIf([k]=0,"",";") & [n].[n_name]')
    handler = Handler("AfterInsert", [_local("k", "0"), _set("r_name", '""'), _each(_if("[k]>=3", Statement("action", "ExitForEachRecord")), sep, _local("k", "[k]+1"))])
    return datamacros.run_handler(handler, _t(spark, sf_dir, "region"), parquet_tables(spark, sf_dir)).rows


_OVER = "SELECT o_custkey FROM (SELECT o_custkey, sum(CAST(round_even(o_totalprice,0) AS BIGINT)) AS s FROM orders GROUP BY 1) WHERE s > 1000000"


@register("macro_loop_raise", f"SELECT c_custkey, CASE WHEN c_custkey IN ({_OVER}) THEN 'over the limit' END AS error FROM customer")
def _(spark, sf_dir):
    handler = Handler("BeforeChange", [_local("total", "CLng(0)"), _orders_of(_local("total", "[total]+CLng([o].[o_totalprice])"), _if("[total]>1000000", Statement("action", "RaiseError", {"Error Description": "over the limit"})))])
    out = datamacros.run_handler(handler, _t(spark, sf_dir, "customer"), parquet_tables(spark, sf_dir))
    return out.rows.select("c_custkey", F.lit(None).cast("string").alias("error")).unionByName(out.errors.select("c_custkey", "error"))


@register("macro_loop_stop", "SELECT r_regionkey, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 21) THEN r_name ELSE r_name || '!' END AS r_name FROM region")
def _(spark, sf_dir):
    handler = Handler("AfterInsert", [_each(_if("[n].[n_nationkey]>21", Statement("action", "StopMacro"))), _set("r_name", '[r_name] & "!"')])
    return datamacros.run_handler(handler, _t(spark, sf_dir, "region"), parquet_tables(spark, sf_dir)).rows


@register("macro_run_named", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 10 WHEN o_totalprice > 200000 THEN o_totalprice + 3 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(spark, sf_dir):
    """A macro that is run with a parameter, from two branches; it runs another in turn."""
    run = lambda name, value: Statement("action", "RunDataMacro", {"MacroName": name, "Parameter:by": value})
    named = {"orders.Add": Handler("Add", [run("orders.Really", "[by]+0")]), "orders.Really": Handler("Really", [_set("o_totalprice", "[o_totalprice]+[by]")])}
    start = Statement("conditional", branches=[("if", "[o_orderstatus]='F'", [run("orders.Add", "10")]), ("elseif", "[o_totalprice]>200000", [run("orders.add", "1+2")])])
    return datamacros.run_handler(Handler("BeforeChange", [start]), _t(spark, sf_dir, "orders"), parquet_tables(spark, sf_dir), named=named).rows.select("o_orderkey", "o_totalprice")


_CHAIN_SQL = """WITH new AS (SELECT o_orderkey + 10000000 AS k, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'P'),
 edited AS (SELECT DISTINCT c_custkey, c_nationkey FROM new JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 5000)
 SELECT 'orders' AS t, CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM new) AS BIGINT) AS n, CAST(0 AS BIGINT) AS s
 UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_custkey IN (SELECT c_custkey FROM edited)) FROM customer
 UNION ALL SELECT 'region', (SELECT count(*) FROM region) + (SELECT count(*) FROM edited), (SELECT sum(c_custkey) FROM edited)
 UNION ALL SELECT 'nation', (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM edited WHERE c_custkey % 100 = 0)), 0"""


@register("macro_trigger_chain", _CHAIN_SQL)
def _(spark, sf_dir):
    """New orders edit customers, whose edits make notes, some of which delete a nation; each by the handler of the table that changed."""
    found = {n: _t(spark, sf_dir, n) for n in ("orders", "customer", "region", "nation")}
    look = lambda table, alias, where, *inner: Statement("block", "LookUpRecord", {"Reference": table, "Alias": alias, "WhereCondition": where}, statements=list(inner))
    edit = Statement("block", "EditRecord", {"Alias": "c"}, statements=[_set("c_mktsegment", '"seen"'), _set("c_acctbal", "[c].[c_acctbal]+0")])
    note = Statement("block", "CreateRecord", {"Reference": "region"}, statements=[_set("r_regionkey", "[c_custkey]"), _set("r_name", '"note"')])
    lookup = look("customer", "c", "[c].[c_custkey]=[r_regionkey]", look("nation", "n", "[n].[n_nationkey]=[c].[c_nationkey]", Statement("action", "DeleteRecord")))
    handlers = {
        "orders": [Handler("BeforeChange", [_if("[o_orderstatus]='P'", Statement("action", "RaiseError", {"Error Description": "pending"}))]), Handler("AfterInsert", [look("customer", "c", "[c].[c_custkey]=[o_custkey] And [c].[c_acctbal]<5000", edit)])],
        "customer": [Handler("AfterUpdate", [note])],
        "region": [Handler("AfterInsert", [_if("[r_regionkey] Mod 100=0", lookup)])],
    }
    new = found["orders"].filter("o_totalprice > 150000").withColumn("o_orderkey", (F.col("o_orderkey") + 10000000).cast(found["orders"].schema["o_orderkey"].dataType))
    after = triggers.insert_rows(found, handlers, "orders", new).tables
    sums = {"orders": F.lit(0), "customer": F.count_if(F.col("c_mktsegment") == "seen"), "region": F.sum(F.when(F.col("r_name") == "note", F.col("r_regionkey")).otherwise(0)), "nation": F.lit(0)}
    parts = [after[t].agg(F.lit(t).alias("t"), F.count(F.lit(1)).alias("n"), c.cast("long").alias("s")) for t, c in sums.items()]
    return functools.reduce(DataFrame.unionByName, parts)


_RINGS = """n AS (SELECT s_suppkey AS id FROM supplier),
 e AS (SELECT DISTINCT src, dst FROM (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 1 FROM supplier WHERE s_suppkey % 10 < 8 UNION ALL SELECT s_suppkey, s_suppkey - s_suppkey % 5 FROM supplier WHERE s_suppkey % 5 IN (2, 4)) WHERE src <> dst AND dst IN (SELECT id FROM n)),
 r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
 c AS (SELECT a.src AS id, min(a.dst) AS comp FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
 inside AS (SELECT e.src, e.dst, x.comp FROM e JOIN c x ON e.src = x.id JOIN c y ON e.dst = y.id AND x.comp = y.comp),
 entry AS (SELECT DISTINCT c.id, c.comp FROM c JOIN e ON e.dst = c.id LEFT JOIN c s ON s.id = e.src WHERE s.comp IS DISTINCT FROM c.comp),
 begun AS (SELECT id FROM entry UNION SELECT comp FROM c WHERE comp NOT IN (SELECT comp FROM entry)),
 d AS (SELECT id, 0 AS steps FROM begun UNION SELECT i.dst, d.steps + 1 FROM d JOIN inside i ON i.src = d.id WHERE d.steps < 50),
 steps AS (SELECT id, min(steps) AS steps FROM d GROUP BY 1),
 back AS (SELECT i.src, i.dst FROM inside i JOIN steps a ON a.id = i.src JOIN steps b ON b.id = i.dst WHERE a.steps > b.steps OR (a.steps = b.steps AND a.id >= b.id)),
 f AS (SELECT src, dst FROM e ANTI JOIN back USING (src, dst)),
 w AS (SELECT id, 0 AS layer FROM n WHERE id NOT IN (SELECT dst FROM f) UNION SELECT f.dst, w.layer + 1 FROM w JOIN f ON f.src = w.id),
 layered AS (SELECT id, max(layer) AS layer FROM w GROUP BY 1)"""


def _rings(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers in rings of five and in chains, and each after the one of half its key."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey")
    to = lambda dst, where="true": s.filter(where).select(F.col("s_suppkey").alias("src"), F.expr(dst).alias("dst"))
    return to("s_suppkey div 2").union(to("s_suppkey + 1", "s_suppkey % 10 < 8")).union(to("s_suppkey - s_suppkey % 5", "s_suppkey % 5 in (2, 4)")), s.select(F.col("s_suppkey").alias("id"))


@register("graph_layers_cyclic", f"WITH RECURSIVE {_RINGS} SELECT id, layer FROM layered")
def _(spark, sf_dir):
    links, nodes = _rings(spark, sf_dir)
    return graph.layers(links, nodes, cycles="cut")


@register(
    "graph_places",
    f"""WITH RECURSIVE {_RINGS}, p0 AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) AS place FROM layered),
 m1 AS (SELECT f.dst AS id, avg(place) AS m FROM f JOIN p0 ON p0.id = f.src GROUP BY 1), p1 AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY coalesce(m, place), place) AS place FROM p0 LEFT JOIN m1 USING (id)),
 m2 AS (SELECT f.src AS id, avg(place) AS m FROM f JOIN p1 ON p1.id = f.dst GROUP BY 1) SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY coalesce(m, place), place) AS place FROM p1 LEFT JOIN m2 USING (id)""",
)
def _(spark, sf_dir):
    links, nodes = _rings(spark, sf_dir)
    forward = graph.forward_links(links.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return graph.places(forward, graph.layers(forward, nodes), sweeps=2)


_SCRIPT = [
    "CREATE TABLE [rich ones] (k LONG NOT NULL, [full name] TEXT(50), amount CURRENCY, CONSTRAINT pk PRIMARY KEY (k));",
    "UPDATE customer SET c_acctbal = c_acctbal + 1000 WHERE c_nationkey = 3;",
    "INSERT INTO [rich ones] (k, [full name], amount) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000;",
    "ALTER TABLE [rich ones] ADD COLUMN orders_of LONG;",
    "DELETE FROM orders WHERE o_orderstatus = 'P';",
    "UPDATE [rich ones] SET orders_of = (SELECT Count(*) FROM orders WHERE o_custkey = k);",
    "SELECT k, orders_of INTO busy FROM [rich ones] WHERE orders_of > 2;",
    "DELETE r.* FROM [rich ones] AS r INNER JOIN busy AS b ON r.k = b.k WHERE b.orders_of > 12;",
    "ALTER TABLE [rich ones] DROP COLUMN [full name];",
    "DROP TABLE busy;",
]


@register("stored_script", "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1000 ELSE c_acctbal END AS amount FROM customer), r AS (SELECT k, round(amount, 2) AS amount, (SELECT count(*) FROM orders WHERE o_custkey = k AND o_orderstatus <> 'P') AS orders_of FROM c WHERE amount > 9000) SELECT k, amount, orders_of FROM r WHERE orders_of <= 12")
def _(spark, sf_dir):
    catalog = scripts.Catalog(spark, parquet_tables(spark, sf_dir), shared_path(spark, "catalog"))
    catalog.run(_SCRIPT)
    return catalog("Rich Ones").select("k", F.col("amount").cast("double").alias("amount"), F.col("orders_of").cast("long").alias("orders_of"))


@register(
    "report_group_spans",
    """SELECT make_timestamp(1899 + 5 * CAST(floor((year(o_orderdate) - 1899) / 5.0) AS BIGINT), 1, 1, 0, 0, 0.0) AS group_0,
 CAST(DATE '1899-12-01' + to_months(CAST(4 * floor((year(o_orderdate) * 12 + month(o_orderdate) - 22800) / 4.0) AS INTEGER)) AS TIMESTAMP) AS group_1,
 CAST(DATE '1899-12-30' + CAST(10 * floor(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) / 10.0) AS INTEGER) AS TIMESTAMP) AS group_2, count(*) AS n FROM orders GROUP BY ROLLUP(1, 2, 3)""",
)
def _(spark, sf_dir):
    """Group levels by five years, by four months and by ten days."""
    level = lambda on, step: f"  Begin BreakLevel\n   ControlSource =\"o_orderdate\"\n   GroupOn ={on}\n   GroupInterval ={step}\n  End\n"
    model = forms.read_form('Begin Report\n RecordSource ="orders"\n Begin\n' + level(2, 5) + level(4, 4) + level(6, 10) + " End\nEnd\n", "rptSpans", "report")
    return screens.report_groups(model, screens.form_rows(model, parquet_tables(spark, sf_dir)), F.count(F.lit(1)).alias("n"))


@register("macro_on_error", "SELECT event_id, CASE WHEN value > 90 AND event_type <> 'view' THEN 'large 7' WHEN value > 50 THEN 'passed' ELSE 'small' END AS event_type FROM events WHERE NOT (value > 90 AND event_type = 'view')")
def _(spark, sf_dir):
    """Errors are refused, passed over after OnError Next, and forgotten after ClearMacroError."""
    fail = lambda least, text: _if(f"[value]>{least}", Statement("action", "RaiseError", {"Error Description": text, "Error Number": "7"}))
    handler = Handler("BeforeChange", [
        _if("[event_type]<>'view'", Statement("action", "OnError", {"GoTo": "Next"})),
        fail(90, "large"),
        _set("event_type", 'IIf([MacroError].[Number]=7,[MacroError].[Description] & " " & [MacroError].[Number],"small")'),
        Statement("action", "ClearMacroError"),
        Statement("action", "OnError", {"GoTo": "Next"}),
        fail(50, "middle"),
        _if('[MacroError].[Description]="middle" And [event_type]="small"', _set("event_type", '"passed"')),
    ])
    return datamacros.run_handler(handler, _t(spark, sf_dir, "events"), parquet_tables(spark, sf_dir)).rows.select("event_id", "event_type")

