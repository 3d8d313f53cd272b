"""Expressions: neutral text, findings, and columns."""

from __future__ import annotations

import pytest

from gridspark.functions.columns import CompileError, compile_expression, frame_context, register_function
from gridspark.functions.grammar import ParseError, parse
from gridspark.functions.neutral import analyse
from gridspark.functions.registry import ADVISORY, DIRECT, REWRITTEN, RUNTIME, aspect_of


@pytest.mark.parametrize(
    ("source", "sql"),
    [
        ('[A].[B] & " " & [A].[C]', "A.B || ' ' || A.C"),
        ("IIf([X]>0,1,0)", "CASE WHEN X > 0 THEN 1 ELSE 0 END"),
        ("IsNull([X])", "(X IS NULL)"),
        ("Nz([X],0)", "COALESCE(X, 0)"),
        ("Now()", "CURRENT_TIMESTAMP"),
        ("Date()", "CURRENT_DATE"),
        ("Year([D])", "EXTRACT(YEAR FROM D)"),
        ("[A] Between 1 And 5", "A BETWEEN 1 AND 5"),
        ("[A] In (1,2)", "A IN (1, 2)"),
        ("Orders.*", "Orders.*"),
        ('[N] Like "A*b?"', "N LIKE 'A%b_'"),
        ("[my field]", '"my field"'),
        ("[Forms]![frmA]![ctlB]", ":Forms_frmA_ctlB"),
        ("[A] Not In (1)", "A NOT IN (1)"),
    ],
)
def test_neutral_text(source, sql):
    found = analyse(source)
    assert found.sql == sql
    assert found.translatable


@pytest.mark.parametrize(
    ("source", "code"),
    [
        ('Format([D],"yyyy")', "ACCESS_RUNTIME_FUNCTION"),
        ('DLookUp("a","b","c")', "ACCESS_RUNTIME_FUNCTION"),
        ("NoSuchThing(1)", "UNKNOWN_FUNCTION"),
        ("[CurrentProject].[IsTrusted]", "ACCESS_OBJECT_MODEL_REFERENCE"),
        ("((", "EXPRESSION_PARSE_FAILED"),
        ("a Eqv b", "LOGICAL_OPERATOR_NOT_IN_SQL"),
        ("Choose(1,2)", "FUNCTION_REWRITE_INCOMPLETE"),
        ("db.Execute(1)", "OBJECT_METHOD_CALL"),
    ],
)
def test_findings_block(source, code):
    found = analyse(source)
    assert code in {f.reason_code for f in found.findings}
    assert not found.translatable


def test_user_functions_and_blank_text():
    assert analyse("GetString(1)", {"getstring"}).findings[0].reason_code == "USER_DEFINED_VBA_FUNCTION"
    blank = analyse("  ")
    assert blank.translatable and blank.sql is None


def test_registry_is_complete():
    assert (len(DIRECT), len(REWRITTEN), len(RUNTIME)) == (31, 29, 43)
    assert aspect_of("IMPLICIT_CROSS_JOIN") == "data_logic" and aspect_of("NEW") == "unclassified"
    assert "LIKE_WILDCARD_DIALECT" in ADVISORY


@pytest.mark.parametrize(
    ("source", "value"),
    [("-2^2", -4.0), ("10+7 Mod 4*2", 17), ("9\\2", 4), ("1/0", None), ("Not 1=2", True), ("Fix(-1.5)", -1), ("Int(-1.5)", -2), ("CInt(2.5)", 2), ('Val("12abc")', 12.0), ('Val("x")', 0.0), ('InStr("hello","l")', 3), ("Sgn(-3)", -1), ('"a" & 1', "a1"), ("True Xor True", False), ("False Imp False", True), ("Choose(2,\"x\",\"y\")", "y"), ('DateDiff("m",#1/31/2020#,#2/1/2020#)', 1), ('Format(0.256,"0.0%")', "25.6%"), ("Partition(5,0,9,5)", " 5: 9")],
)
def test_columns(spark, source, value):
    assert spark.range(1).select(compile_expression(source, frame_context({}))).first()[0] == value


def test_unresolved_names_and_functions_fail(spark):
    with pytest.raises(CompileError):
        compile_expression("[nothing]", frame_context({"a": "int"}))
    with pytest.raises(CompileError):
        compile_expression("Shell(1)", frame_context({}))
    with pytest.raises(ParseError):
        parse("1 +")


def test_registered_function_is_called(spark):
    register_function("TwiceOf", lambda x: x * 2)
    assert spark.range(3, 4).select(compile_expression("TwiceOf([id])", frame_context({"id": "bigint"}))).first()[0] == 6
