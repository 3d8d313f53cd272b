"""The functions of the expression language and the findings about expressions."""

from __future__ import annotations

from dataclasses import dataclass

#: Functions by kind of support. "sql": one function of the same meaning;
#: "rewrite": another shape of expression; "runtime": no portable meaning is claimed.
DIRECT = {
    "abs": "ABS", "sgn": "SIGN", "sqr": "SQRT", "exp": "EXP", "log": "LN", "round": "ROUND", "len": "CHAR_LENGTH", "ucase": "UPPER", "lcase": "LOWER",
    "trim": "TRIM", "ltrim": "LTRIM", "rtrim": "RTRIM", "left": "LEFT", "right": "RIGHT", "replace": "REPLACE", "asc": "ASCII", "chr": "CHR",
    "date": "CURRENT_DATE", "now": "CURRENT_TIMESTAMP", "time": "CURRENT_TIME",
    "sum": "SUM", "avg": "AVG", "min": "MIN", "max": "MAX", "count": "COUNT", "first": "FIRST", "last": "LAST", "stdev": "STDEV", "stdevp": "STDEVP", "var": "VAR", "varp": "VARP",
}
REWRITTEN = frozenset(
    """int fix mid instr space nz iif switch choose isnull year month day hour minute second
    cint clng cdbl csng ccur cstr cdate cbool cbyte cdec cvar val str""".split()
)
RUNTIME = frozenset(
    """string isnumeric isdate iserror isempty isobject isarray weekday datepart datediff dateadd dateserial timeserial datevalue timevalue format
    dlookup dcount dsum davg dmin dmax dfirst dlast dstdev dvar
    eval environ command shell createobject getobject currentuser currentproject currentdb codedb application doevents msgbox inputbox
    partition rnd randomize""".split()
)
AGGREGATES = frozenset("sum avg min max count first last stdev stdevp var varp".split())
DOMAIN = frozenset("dlookup dcount dsum davg dmin dmax dfirst dlast dstdev dvar".split())
#: Functions that this engine runs although no portable SQL form is claimed for them.
EXTENSIONS = frozenset("string isnumeric isdate iserror isempty isobject isarray weekday datepart datediff dateadd dateserial timeserial datevalue timevalue format partition choose cvar".split()) | DOMAIN
#: Names that refer to the host application, not to data.
HOST_ROOTS = frozenset({"currentproject", "currentdb", "application", "codeproject", "codedb", "docmd", "screen", "currentdata", "codedata", "dbengine", "err", "me", "tempvars"})
UI_ROOTS = frozenset({"forms", "reports"})

#: Reason codes by aspect.
ASPECTS = {
    "structure": """SEMANTIC_PARSE_FAILED OBJECT_BLOCK_NOT_FOUND TABLE_ELEMENT_NOT_FOUND OBJECT_KIND_NOT_TRANSLATED SOURCE_TEXT_NOT_RETAINED
        SOURCE_DEFINITION_UNAVAILABLE MACRO_STORED_AS_FLAT_ACTION_LIST MACRO_AXL_NOT_PARSED MACRO_ELEMENT_NOT_RECOGNISED STORED_SQL_NOT_RE_PARSED
        QUERY_OPERATION_CODE_NOT_MAPPED QUERY_OPTION_BITS_NOT_MAPPED JOIN_FLAG_NOT_MAPPED JOIN_GRAPH_NOT_RESOLVED RELATIONSHIP_XML_NOT_PARSED
        SEMANTIC_MODEL_INCOMPLETE""".split(),
    "data_logic": """JET_FIELD_TYPE_NOT_MAPPED FIELD_TYPE_HAS_NO_PORTABLE_EQUIVALENT EXPRESSION_PARSE_FAILED EXPRESSION_NODE_NOT_TRANSLATED
        ACCESS_RUNTIME_FUNCTION USER_DEFINED_VBA_FUNCTION UNKNOWN_FUNCTION FUNCTION_REWRITE_INCOMPLETE LOGICAL_OPERATOR_NOT_IN_SQL IMPLICIT_CROSS_JOIN
        NON_SELECT_QUERY_SQL_NOT_GENERATED PASS_THROUGH_QUERY_TARGETS_EXTERNAL_SERVER""".split(),
    "application_logic": """ACCESS_OBJECT_MODEL_REFERENCE OBJECT_METHOD_CALL EMBEDDED_MACRO_BODY_NOT_IN_TEXT_DEFINITION
        CONTROL_TYPE_HAS_NO_PORTABLE_EQUIVALENT ROW_SOURCE_TYPE_NOT_A_QUERY MACRO_ACTION_UI_NOT_TRANSLATABLE MACRO_ACTION_SYSTEM_NOT_TRANSLATABLE
        MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE VBA_DRIVES_ACCESS_UI VBA_INTERACTIVE_DIALOG VBA_STARTS_EXTERNAL_PROCESS VBA_AUTOMATION_OBJECT
        VBA_SENDS_KEYSTROKES VBA_FILE_SYSTEM_ACCESS VBA_HOST_ENVIRONMENT VBA_ACCESS_APPLICATION_OBJECT VBA_ACCESS_FORM_REFERENCE
        VBA_ACCESS_REPORT_REFERENCE VBA_DECLARES_EXTERNAL_LIBRARY""".split(),
    "advisory": """LIKE_WILDCARD_DIALECT UI_REFERENCE_BECOMES_PARAMETER TOP_CLAUSE_IS_DIALECT_SPECIFIC INT_FIX_ROUNDING NZ_DEFAULT_DEPENDS_ON_TYPE
        INTEGER_DIVISION_SEMANTICS""".split(),
}
ASPECT_OF = {code: aspect for aspect, codes in ASPECTS.items() for code in codes}
ADVISORY = frozenset(ASPECTS["advisory"])


@dataclass(frozen=True)
class Finding:
    reason_code: str
    detail: str
    note: str = ""

    @property
    def blocking(self) -> bool:
        return self.reason_code not in ADVISORY


def aspect_of(code: str) -> str:
    return ASPECT_OF.get(code, "unclassified")


def support_of(name: str) -> str | None:
    name = name.lower()
    return "sql" if name in DIRECT else "rewrite" if name in REWRITTEN else "runtime" if name in RUNTIME else None
