"""Registered queries of package conversion: each supplier is a package, made of its row, read and converted.

The parts' text depends on the supplier's key, so SQL over the same rows says what
must be found: objects, findings, procedures, control flow, edges, features, diagnostics.
"""

from __future__ import annotations

import functools
import io
import struct
import warnings
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalogue import grid, register, stored
from gridspark.plans.tables import dealt
from gridspark.sources import catalogs, inventory, packages
from gridspark.sources.convert import OF_EDGES, OF_OBJECTS, OF_PAYLOAD, Conversion, convert_parts

#: Files that a task makes before it hands them over.
MADE = 200
OBJECTS = "template/database/objects/"
_XSD = """<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:od="urn:schemas-microsoft-com:officedata">
<xsd:element name="{name}"><xsd:complexType><xsd:sequence>{columns}</xsd:sequence></xsd:complexType></xsd:element></xsd:schema>"""
_FORM = """Begin Form
    RecordSource ="{source}"
    OnLoad ="[Event Procedure]"
    Begin
        Begin Section
            Name ="Detail"
            Begin
                Begin TextBox
                    Name ="txt"
                    ControlSource ="c0"
                End
                Begin Subform
                    Name ="sub"
                    SourceObject ="Form.{lines}"
                End
                Begin CommandButton
                    Name ="cmd"
                    OnClick ="{macro}"
                End
            End
        End
    End
End
Option Explicit
Sub Form_Load()
  Work
End Sub
"""
_LINES = 'Begin Form\n    RecordSource ="{source}"\nEnd\n'
_FLOW = (
    'Begin\n    Comment ="_AXL:<UserInterfaceMacro xmlns=\\"http://schemas.microsoft.com/office/accessservices/2009/11/application\\"><Statements>'
    '<Action Name=\\"OpenForm\\"><Argument Name=\\"FormName\\">{lines}</Argument></Action><Action Name=\\"RunCode\\"><Argument Name=\\"FunctionName\\">Work()</Argument></Action>'
    '</Statements></UserInterfaceMacro>"\nEnd\n'
)
_RELATED = "<MSysRelationships><szRelationship>{name}</szRelationship><szObject>{child}</szObject><szReferencedObject>{parent}</szReferencedObject><szColumn>{column}</szColumn><szReferencedColumn>{other}</szReferencedColumn><grbit>{bits}</grbit></MSysRelationships>"
_AXL = '<DataMacros xmlns="http://schemas.microsoft.com/office/accessservices/2009/11/application"><DataMacro Event="AfterInsert"><Statements><Action Name="SetField"/></Statements></DataMacro></DataMacros>'


def package_of(k: int) -> bytes:
    """The package of key k. Every tenth has an entry outside its folder, every fourth query an unknown function, the next one none,
    every third module a branch; macros beep where k is even."""
    columns = "".join(f'<xsd:element name="c{i}" od:jetType="longinteger"/>' for i in range(k % 3 + 1))
    branch = "    If i > 2 Then\n      Exit For\n    Else\n      x = 1\n    End If\n" if k % 3 == 0 else ""
    table, query, form, lines, flow = (f"{n}{k}" for n in ("Kegs", "Open", "Main", "Lines", "Flow"))
    pairs = [("KegsLines", "c0", "c0", 4096 if k % 2 else 0), *([("KegsLines", "c1", "c1", 4096)] if k % 2 else []), ("Loose", "c0", "c0", 2)]
    parts = {
        "template/template.xml": "<x/>",
        "template/database/navpane.xml": "<x/>",
        "template/other/formStray.txt": "Begin Form\nEnd\n",
        packages.RELATIONSHIPS: "<dataroot>" + "".join(_RELATED.format(name=n, child=lines, parent=table, column=c, other=o, bits=b) for n, c, o, b in pairs) + "</dataroot>" if k % 7 else "<dataroot>",
        f"{OBJECTS}sampledata/{k}.xml": "<x/>",
        "_rels/.rels": "<x/>",
        f"{OBJECTS}table{table}.xsd": _XSD.format(name=table, columns=columns),
        f"{OBJECTS}query{query}.txt": grid([table], [("IIf([c0]>1,1,0)", "a"), (("NoSuchThing(1)", "[c0]", "Work()", "Work()")[k % 4], "b")]),
        f"{OBJECTS}form{form}.txt": _FORM.format(source=query, lines=lines, macro=flow),
        f"{OBJECTS}form{lines}.txt": _LINES.format(source=table),
        f"{OBJECTS}macroDo{k}.txt": f'Begin\n Action ="{"SetLocalVar" if k % 2 else "Beep"}"\nEnd\n',
        f"{OBJECTS}macro{flow}.txt": _FLOW.format(lines=lines),
        f"{OBJECTS}moduleCode{k}.txt": f'Sub OpenIt()\n  DoCmd.OpenForm "{form}"\n  s = "SELECT * FROM {table}"\n  Work\nEnd Sub\nFunction Work()\n  For i = 1 To {k}\n{branch}  Next i\nEnd Function\n',
        f"{OBJECTS}datamacros/datamacros{table}.axl": _AXL,
    }
    if k % 10 == 0:
        parts["../outside.txt"] = "x"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, text in parts.items():
            package.writestr(name, text)
    return out.getvalue()


def made_files(rows: DataFrame, made: Callable[[int], tuple[str, bytes]]) -> DataFrame:
    """files(path, content) of the keys in `rows`, dealt over tasks; a task hands over MADE files at a time."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [int(k) for k in batch.iloc[:, 0]]
            for i in range(0, len(keys), MADE):
                yield pd.DataFrame([made(k) for k in keys[i : i + MADE]], columns=["path", "content"])

    return dealt(rows).mapInPandas(work, "path string, content binary")


def _keys(spark, sf_dir: str, table: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)


def entries(spark, sf_dir: str) -> DataFrame:
    """The entries of all packages, read from their bytes."""
    return packages.package_entries(made_files(_keys(spark, sf_dir, "supplier", "s_suppkey"), lambda k: (str(k), package_of(k))))


def converted(spark, sf_dir: str, *kept: str) -> Conversion:
    """All packages, converted; of the records, the sorts that are `kept` (all, without any)."""
    return convert_parts(packages.object_parts(entries(spark, sf_dir)), *kept)


def database_of(layout: catalogs.Layout, names: list[tuple[str, int]]) -> bytes:
    """A binary database of objects (name, type code): a header, an empty page, the catalog's definition and its rows."""
    columns = [("Name", 0, False, 0, 0, 0), ("Type", 1, True, 0, 0, 2)]
    old = layout.count_size == 1
    head = bytearray(layout.page)
    head[4:20] = catalogs.SIGNATURES[0]
    head[20] = 0 if old else 1
    definition = bytearray(layout.page)
    definition[0] = catalogs.DEFINITION
    struct.pack_into("<H", definition, layout.columns_at, 2)
    at = layout.body_at
    for _, number, fixed, offset, variable, width in columns:
        struct.pack_into("<B" if old else "<H", definition, at + layout.number_at, number)
        struct.pack_into("<H", definition, at + layout.variable_at, variable)
        definition[at + layout.flags_at] = int(fixed)
        struct.pack_into("<H", definition, at + layout.fixed_at, offset)
        struct.pack_into("<H", definition, at + layout.width_at, width)
        at += layout.column_size
    for name, *_ in columns:
        raw = name.encode("cp1252" if old else "utf-16-le")
        definition[at : at + layout.count_size] = len(raw).to_bytes(layout.count_size, "little")
        definition[at + layout.count_size : at + layout.count_size + len(raw)] = raw
        at += layout.count_size + len(raw)
    data = bytearray(layout.page)
    data[0] = catalogs.DATA
    struct.pack_into("<I", data, 4, catalogs.CATALOG_PAGE)
    struct.pack_into("<H", data, layout.rows_at, len(names))
    end = layout.page
    for i, (name, code) in enumerate(names):
        if old:
            raw = name.encode("cp1252")
            body = bytes([2]) + struct.pack("<h", code) + raw + bytes([3 + len(raw), 3, 1, 3])
        else:
            raw = b"\xff\xfe" + name.encode("latin-1")
            body = struct.pack("<Hh", 2, code) + raw + struct.pack("<HHHB", 4 + len(raw), 4, 1, 3)
        end -= len(body)
        data[end : end + len(body)] = body
        struct.pack_into("<H", data, layout.rows_at + 2 + 2 * i, end)
    return bytes(head) + bytes(layout.page) + bytes(definition) + bytes(data)


def catalog_rows(spark, sf_dir: str) -> DataFrame:
    """The objects of one binary database a supplier: the old page format where the key is even, no database for every tenth."""

    def made(k: int) -> tuple[str, bytes]:
        names = [(f"Kunden{k}", 1), (f"fern{k}", 6), (f"abfrage{k}", 5), (f"~sq_f{k}", 5), (f"form{k}", -32768), (f"bericht{k}", -32764), (f"makro{k}", -32766), (f"modul{k}", -32761), ("MSysObjects", 1), ("~TMPCLP1", 1), ("Tables", 3)]
        return str(k), b"no database" if k % 10 == 0 else database_of(catalogs.OLD if k % 2 == 0 else catalogs.NEW, names)

    return packages.catalog_objects(made_files(_keys(spark, sf_dir, "supplier", "s_suppkey"), made))


_K = "s_suppkey"
_GOOD = f"(SELECT {_K} AS k, CAST({_K} AS VARCHAR) AS path FROM supplier WHERE {_K} % 10 <> 0)"


def _each(columns: str, where: str = "true") -> str:
    return f"SELECT {columns} FROM {_GOOD} WHERE {where}"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_OBJECT_SQL = _union(
    _each("path, 'Kegs' || path AS object, 'table' AS kind, true AS translated"),
    _each("path, 'Open' || path, 'query', k % 4 = 1"),
    _each("path, 'Main' || path, 'form', true"),
    _each("path, 'Lines' || path, 'form', true"),
    _each("path, 'Do' || path, 'macro', false"),
    _each("path, 'Flow' || path, 'macro', false"),
    _each("path, 'Code' || path, 'module', false"),
    _each("path, 'Kegs' || path, 'datamacro', true"),
)


@register("package_objects", _OBJECT_SQL)
def _(spark, sf_dir):
    return converted(spark, sf_dir, *OF_OBJECTS).objects().select("path", "object", "kind", "translated")


@register(
    "package_findings",
    _union(
        _each("path, 'Open' || path AS object, CASE k % 4 WHEN 0 THEN 'UNKNOWN_FUNCTION' ELSE 'USER_DEFINED_VBA_FUNCTION' END AS reason_code", "k % 4 <> 1"),
        _each("path, 'Do' || path, 'MACRO_STORED_AS_FLAT_ACTION_LIST'"),
        _each("path, 'Do' || path, 'MACRO_ACTION_UI_NOT_TRANSLATABLE'", "k % 2 = 0"),
        _each("path, 'Flow' || path, 'MACRO_ACTION_UI_NOT_TRANSLATABLE'"),
        _each("path, 'Flow' || path, 'MACRO_ACTION_SYSTEM_NOT_TRANSLATABLE'"),
        _each("path, 'Code' || path, 'VBA_DRIVES_ACCESS_UI'"),
        _each("path, 'relationships', 'RELATIONSHIP_XML_NOT_PARSED'", "k % 7 = 0"),
    ),
)
def _(spark, sf_dir):
    return converted(spark, sf_dir, "finding").findings().select("path", "object", "reason_code")


@register(
    "package_relationships",
    _union(
        _each("path, 'KegsLines' AS name, 'Lines' || path AS child, 'Kegs' || path AS parent, CASE k % 2 WHEN 1 THEN 'c0,c1' ELSE 'c0' END AS child_columns, true AS enforced, k % 2 = 1 AS cascade_delete", "k % 7 <> 0"),
        _each("path, 'Loose', 'Lines' || path, 'Kegs' || path, 'c0', false, false", "k % 7 <> 0"),
    ),
)
def _(spark, sf_dir):
    return converted(spark, sf_dir, "relationship").relationships().select("path", "name", "child", "parent", F.array_join("child_columns", ",").alias("child_columns"), "enforced", "cascade_delete")


@register(
    "package_procedures",
    _union(
        _each("path, 'Code' || path AS object, 'OpenIt' AS name, 3 AS statements, 0 AS branches, 0 AS loops, 1 AS cyclomatic_complexity"),
        _each("path, 'Code' || path, 'Work', CASE k % 3 WHEN 0 THEN 4 ELSE 1 END, CASE k % 3 WHEN 0 THEN 2 ELSE 0 END, 1, CASE k % 3 WHEN 0 THEN 4 ELSE 2 END"),
        _each("path, 'Main' || path, 'Form_Load', 1, 0, 0, 1"),
    ),
)
def _(spark, sf_dir):
    return converted(spark, sf_dir, "procedure").procedures().select("path", "object", "name", "statements", "branches", "loops", "cyclomatic_complexity")


@register(
    "package_edges",
    _union(
        _each("path, 'query:open' || path AS src, 'table:kegs' || path AS dst, 'reads' AS edge"),
        _each("path, 'form:main' || path, 'query:open' || path, 'reads'"),
        _each("path, 'form:lines' || path, 'table:kegs' || path, 'reads'"),
        _each("path, 'form:main' || path, 'form:lines' || path, 'embeds'"),
        _each("path, 'form:main' || path, 'proc:main' || path || ':form_load', 'contains'"),
        _each("path, 'form:main' || path, 'proc:main' || path || ':form_load', 'handles'"),
        _each("path, 'form:main' || path, 'macro:flow' || path, 'handles'"),
        _each("path, 'datamacro:kegs' || path, 'table:kegs' || path, 'trigger'"),
        _each("path, 'macro:flow' || path, 'form:lines' || path, 'opens'"),
        _each("path, 'macro:flow' || path, 'proc:code' || path || ':work', 'calls'"),
        _each("path, 'module:code' || path, 'proc:code' || path || ':openit', 'contains'"),
        _each("path, 'module:code' || path, 'proc:code' || path || ':work', 'contains'"),
        _each("path, 'proc:code' || path || ':openit', 'proc:code' || path || ':work', 'calls'"),
        _each("path, 'proc:main' || path || ':form_load', 'proc:code' || path || ':work', 'calls'"),
        _each("path, 'proc:code' || path || ':openit', 'form:main' || path, 'opens'"),
        _each("path, 'proc:code' || path || ':openit', 'table:kegs' || path, 'reads'"),
    ),
)
def _(spark, sf_dir):
    return converted(spark, sf_dir, *OF_EDGES).edges()


@register("package_features", _union(*[_each(f"path, '{f}' AS feature, 'not_started' AS status, '{c}' AS reason_code, CAST({n} AS BIGINT) AS entries, CAST({o} AS BIGINT) AS objects") for f, c, n, o in [*[(f, c, 2 if f == "package_metadata" else 1, "NULL") for f, _, c in packages.FEATURES if f in ("table_data", "relationships", "navigation_pane", "package_relationships", "package_metadata")], (*packages.TARGET, 0, 8)]]))
def _(spark, sf_dir):
    return packages.features(entries(spark, sf_dir)).drop("names")


@register("package_diagnostics", f"SELECT CAST({_K} AS VARCHAR) AS path, 'UNSAFE_PACKAGE_PATH' AS diagnostic FROM supplier WHERE {_K} % 10 = 0")
def _(spark, sf_dir):
    return entries(spark, sf_dir).filter("diagnostic is not null").select("path", "diagnostic")


@register("package_hashes", _each(f"path, '{OBJECTS}sampledata/' || path || '.xml' AS name, CAST(4 AS BIGINT) AS size, sha256('<x/>') AS sha256, 'utf-8-sig' AS encoding"))
def _(spark, sf_dir):
    return entries(spark, sf_dir).filter(F.col("name").contains("/sampledata/")).select("path", "name", "size", "sha256", "encoding")


@register("package_summary", f"SELECT path, kind, count(*) AS objects, count(*) FILTER (translated) AS complete, CASE WHEN bool_or(translated) THEN 100.0 ELSE 0.0 END AS completion_percentage FROM ({_OBJECT_SQL}) GROUP BY 1, 2")
def _(spark, sf_dir):
    return converted(spark, sf_dir, *OF_OBJECTS).summary()


_CODE_SQL = _union(
    "SELECT 'MACRO_STORED_AS_FLAT_ACTION_LIST' AS name, count(*) AS n FROM g",
    "SELECT 'VBA_DRIVES_ACCESS_UI', count(*) FROM g",
    "SELECT 'MACRO_ACTION_UI_NOT_TRANSLATABLE', count(*) + count(*) FILTER (k % 2 = 0) FROM g",
    "SELECT 'MACRO_ACTION_SYSTEM_NOT_TRANSLATABLE', count(*) FROM g",
    "SELECT 'RELATIONSHIP_XML_NOT_PARSED', count(*) FILTER (k % 7 = 0) FROM g",
    "SELECT 'UNKNOWN_FUNCTION', count(*) FILTER (k % 4 = 0) FROM g",
    "SELECT 'USER_DEFINED_VBA_FUNCTION', count(*) FILTER (k % 4 > 1) FROM g",
)


@register(
    "package_corpus_report",
    f"""WITH g AS {_GOOD}, o AS ({_OBJECT_SQL}), t AS (SELECT count(DISTINCT path) AS artifacts, count(*) AS objects, count(*) FILTER (translated) AS complete FROM o)
 SELECT 'blocking_code' AS measure, name, CAST(n AS DOUBLE) AS value FROM ({_CODE_SQL}) WHERE n > 0
 UNION ALL SELECT 'total', 'artifacts', artifacts FROM t UNION ALL SELECT 'total', 'objects', objects FROM t UNION ALL SELECT 'total', 'extracted', objects FROM t
 UNION ALL SELECT 'total', 'complete', complete FROM t UNION ALL SELECT 'total', 'partial', objects - complete FROM t
 UNION ALL SELECT 'total', 'extraction_percentage', 100.0 FROM t UNION ALL SELECT 'total', 'semantic_percentage', round(complete * 100.0 / objects, 2) FROM t""",
)
def _(spark, sf_dir):
    return converted(spark, sf_dir, *OF_OBJECTS).corpus_report()


@register("package_payload", _each("path, 8 AS objects, 3 AS procedures, 16 AS edges, CASE k % 4 WHEN 0 THEN 'UNKNOWN_FUNCTION' WHEN 1 THEN NULL ELSE 'USER_DEFINED_VBA_FUNCTION' END AS query_problem"))
def _(spark, sf_dir):
    payload = F.from_json("payload", "objects array<struct<kind:string,problems:array<struct<reason_code:string>>>>, procedures array<struct<name:string>>, edges array<struct<edge:string>>").alias("p")
    rows = converted(spark, sf_dir, *OF_PAYLOAD).payload().select("path", payload)
    query = F.filter("p.objects", lambda o: o["kind"] == "query")
    return rows.select("path", F.size("p.objects").alias("objects"), F.size("p.procedures").alias("procedures"), F.size("p.edges").alias("edges"), F.get(F.get(query, 0)["problems"], 0)["reason_code"].alias("query_problem"))


def _flow(proc: str, edges: list[tuple[int, int, str]], where: str = "true") -> list[str]:
    return [_each(f"path, '{proc}' AS proc, {a} AS \"from\", {b} AS \"to\", '{label}' AS label", where) for a, b, label in edges]


#: A loop around a branch with an exit, and a loop of nothing.
_BRANCH = [(0, 1, ""), (1, 2, "loop_body"), (2, 3, "yes"), (2, 4, "no"), (4, 1, "loop_next"), (1, 5, "loop_exit"), (3, 5, "break")]
_EMPTY = [(0, 1, ""), (1, 1, "loop_body"), (1, 2, "loop_exit")]


@register("package_flow", _union(*_flow("OpenIt", [(i, i + 1, "") for i in range(4)]), *_flow("Form_Load", [(0, 1, ""), (1, 2, "")]), *_flow("Work", _BRANCH, "k % 3 = 0"), *_flow("Work", _EMPTY, "k % 3 <> 0")))
def _(spark, sf_dir):
    return converted(spark, sf_dir, "cfg_edge").cfg_edges().filter(F.col("proc").isin("OpenIt", "Form_Load", "Work")).select("path", "proc", "from", "to", "label")


_CATALOG = [("Kunden", 1, "table"), ("fern", 6, "linked_table"), ("abfrage", 5, "query"), ("~sq_f", 5, "query"), ("form", -32768, "form"), ("bericht", -32764, "report"), ("makro", -32766, "macro"), ("modul", -32761, "module")]


@register("catalog_objects", _union(*[_each(f"path, CASE k % 2 WHEN 0 THEN 'jet3' ELSE 'jet4' END AS format, '{n}' || path AS name, {c} AS type_code, '{kind}' AS kind, {str(n.startswith('~')).lower()} AS hidden") for n, c, kind in _CATALOG]))
def _(spark, sf_dir):
    return catalog_rows(spark, sf_dir).filter("diagnostic is null").select("path", "format", "name", "type_code", "kind", "hidden")


@register("catalog_diagnostics", f"SELECT CAST({_K} AS VARCHAR) AS path FROM supplier WHERE {_K} % 10 = 0")
def _(spark, sf_dir):
    return catalog_rows(spark, sf_dir).filter("diagnostic is not null").select("path")


def _inputs(spark, sf_dir: str) -> DataFrame:
    """Files of all sorts by key: packages (whole, unsafe, no archive), databases of both formats and broken ones, texts."""

    def made(k: int) -> tuple[str, bytes]:
        name, content = (lambda: ("a.accdt", package_of(k)), lambda: ("b.MDB", database_of(catalogs.OLD, [("t", 1)])), lambda: ("c.accdb", b"x" * 5000), lambda: ("d.txt", b"x"), lambda: ("e.accdt", b"x"))[k % 5]()
        return f"{k}/{name}", content

    return made_files(_keys(spark, sf_dir, "supplier", "s_suppkey"), made)


_INPUT_SQL = f"""SELECT {_K} || CASE {_K} % 5 WHEN 0 THEN '/a.accdt' WHEN 1 THEN '/b.MDB' WHEN 2 THEN '/c.accdb' WHEN 3 THEN '/d.txt' ELSE '/e.accdt' END AS path,
 CASE {_K} % 5 WHEN 0 THEN 'accdt' WHEN 1 THEN %s WHEN 2 THEN %s WHEN 4 THEN 'accdt' END AS family,
 CASE {_K} % 5 WHEN 0 THEN CASE WHEN {_K} % 10 = 0 THEN 'failed' ELSE 'converted' END WHEN 1 THEN %s WHEN 4 THEN 'failed' ELSE 'unsupported' END AS status,
 CASE {_K} % 5 WHEN 0 THEN CASE WHEN {_K} % 10 = 0 THEN 'UNSAFE_PACKAGE_PATH' END WHEN 1 THEN %s WHEN 2 THEN %s WHEN 3 THEN 'UNSUPPORTED_INPUT_FORMAT' ELSE 'INVALID_ACCDT_PACKAGE' END AS reason_code,
 CASE WHEN {_K} % 5 = 0 AND {_K} % 10 <> 0 THEN 8 WHEN {_K} % 5 = 1 THEN %s ELSE 0 END AS objects FROM supplier""".replace(" % ", " %% ")


@register("input_status", _INPUT_SQL % ("'jet3'", "NULL", "'discovered'", "'BINARY_OBJECT_DEFINITION_EXTRACTION_NOT_IMPLEMENTED'", "'BINARY_CATALOG_NOT_READABLE'", "1"))
def _(spark, sf_dir):
    return packages.input_status(_inputs(spark, sf_dir))


@register("input_status_in_memory", _INPUT_SQL % ("'jet_or_ace_binary'", "'jet_or_ace_binary'", "'unsupported'", "'BINARY_INPUT_REQUIRES_A_FILE_PATH'", "'BINARY_INPUT_REQUIRES_A_FILE_PATH'", "0"))
def _(spark, sf_dir):
    return packages.input_status(_inputs(spark, sf_dir), in_memory=True)


# inventories: a customer is a sample with one database
def _inventory(spark, sf_dir: str) -> inventory.Inventory:
    """The files' texts, made of the key; every fiftieth has a fault, of four sorts."""
    k = dealt(_keys(spark, sf_dir, "customer", "c_custkey")).select(F.col("c_custkey").cast("int").alias("k"))
    listed = lambda name, kind, n: f"transform(slice(array(0,1,2,3), 1, k % {n}), i -> named_struct('name', concat('{name}', i), 'kind', '{kind}'))"
    database = f"""named_struct('file', concat(k, '.mdb'), 'format', if(k % 200 = 100, 'Paper 1', if(k % 3 = 0, 'ACE 12', 'Jet 4')),
        'counts', map('Table', 3 + int(k % 5 = 0), 'Linked  Table', k % 3, if(k % 200 = 50, 'Gadget', 'Hidden Query'), k % 2),
        'objects', concat({listed("t", "Table", 4)}, {listed("q", "Hidden Query (~sq_)", 2)}, if(k % 200 = 150, array(named_struct('name', 'x', 'kind', 'macro')), array())))"""
    text = F.expr(f"if(k % 200 = 0, '{{', to_json(named_struct('sample', concat('s', k), 'databases', array({database}))))")
    return inventory.read_units(k.select(F.col("k").cast("string").alias("source"), text.alias("content")))


_C = "(SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS source FROM customer WHERE c_custkey % 50 <> 0 OR c_custkey % 200 = 150)"


@register(
    "inventory_counts",
    _union(
        f"SELECT source, 'table' AS bucket, 3 + CASE k % 5 WHEN 0 THEN 1 ELSE 0 END AS declared, k % 4 AS named, 3 + CASE k % 5 WHEN 0 THEN 1 ELSE 0 END - k % 4 AS residual FROM {_C}",
        f"SELECT source, 'table_linked', k % 3, 0, k % 3 FROM {_C}",
        f"SELECT source, 'query_hidden', k % 2, k % 2, 0 FROM {_C}",
        f"SELECT source, 'macro', 0, 1, -1 FROM {_C} WHERE k % 200 = 150",
    ),
)
def _(spark, sf_dir):
    return _inventory(spark, sf_dir).counts().select("source", "bucket", "declared", "named", "residual")


@register("inventory_count_only", f"SELECT * FROM (SELECT 's' || source AS sample, source || '.mdb' AS artifact, CASE k % 3 WHEN 0 THEN 'ace' ELSE 'jet4' END AS format_family, 'table' AS bucket, 3 + CASE k % 5 WHEN 0 THEN 1 ELSE 0 END - k % 4 AS weight FROM {_C} UNION ALL SELECT 's' || source, source || '.mdb', CASE k % 3 WHEN 0 THEN 'ace' ELSE 'jet4' END, 'table_linked', k % 3 FROM {_C}) WHERE weight > 0")
def _(spark, sf_dir):
    return _inventory(spark, sf_dir).count_only().drop("source")


@register("inventory_faults", "SELECT CAST(c_custkey AS VARCHAR) AS source, CASE c_custkey % 200 WHEN 0 THEN 'the file is no JSON' WHEN 50 THEN 'count key ''Gadget'' is unknown' WHEN 100 THEN 'format ''paper 1'' is unknown' ELSE 'macro of ' || c_custkey || '.mdb: 0 declared, 1 named' END AS fault FROM customer WHERE c_custkey % 50 = 0")
def _(spark, sf_dir):
    return _inventory(spark, sf_dir).faults()


# value lists and macros as text
@register("expression_findings", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'LIKE_WILDCARD_DIALECT' WHEN 1 THEN 'UNKNOWN_FUNCTION' ELSE 'NZ_DEFAULT_DEPENDS_ON_TYPE' END AS code FROM part")
def _(spark, sf_dir):
    text = F.expr("CASE p_size % 3 WHEN 0 THEN concat('[x] Like ', chr(34), 'a*', p_size, chr(34)) WHEN 1 THEN concat('Gadget', p_size, '(1)') ELSE 'Nz([x])' END")
    rows = packages.expression_rows(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("source")))
    return rows.select("p_partkey", F.explode("codes").alias("code"))


@functools.cache
def _limited(kind: int) -> bytes:
    """A package that breaks one of seven rules; that of kind 0 is whole."""
    out = io.BytesIO()
    if kind == 1:
        return b"PK no archive"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of names that are there twice
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
            if kind != 2:
                package.writestr(packages.TEMPLATE, "<x/>")
            package.writestr({3: "/template/x.txt", 4: "template\\..\\x.txt"}.get(kind, "template/x.txt"), "0" * (3 << 20) if kind == 5 else "x")
            if kind == 6:
                package.writestr("Template/X.txt", "y")
            if kind == 7:
                link = zipfile.ZipInfo("template/link")
                link.external_attr = 0o120777 << 16
                package.writestr(link, "x.txt")
    return out.getvalue()


@register("package_limits", "SELECT CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 8 WHEN 1 THEN 'INVALID_ACCDT_PACKAGE' WHEN 2 THEN 'INVALID_ACCDT_PACKAGE' WHEN 3 THEN 'UNSAFE_PACKAGE_PATH' WHEN 4 THEN 'UNSAFE_PACKAGE_PATH' WHEN 5 THEN 'PACKAGE_LIMIT_EXCEEDED' WHEN 6 THEN 'DUPLICATE_PACKAGE_ENTRY' WHEN 7 THEN 'UNSAFE_PACKAGE_ENTRY_TYPE' END AS diagnostic FROM customer")
def _(spark, sf_dir):
    files = made_files(_keys(spark, sf_dir, "customer", "c_custkey"), lambda k: (str(k), _limited(k % 8)))
    return packages.package_entries(files).groupBy("path").agg(F.max("diagnostic").alias("diagnostic"))


#: Parts (kind, text) with the codes that each has to give.
_CODED: list[tuple[str, str, list[str]]] = [
    ("query", grid(["t"], [("[a]", "b")], where="[a] Like 'x*'"), ["LIKE_WILDCARD_DIALECT"]),
    ("query", grid(["t"], [("Gadget([a])", "b")]), ["UNKNOWN_FUNCTION"]),
    ("query", grid(["t"], [("Nz([a])", "b"), ("Int([a])", "c"), ("[a]\\2", "d")]), ["NZ_DEFAULT_DEPENDS_ON_TYPE", "INT_FIX_ROUNDING", "INTEGER_DIVISION_SEMANTICS"]),
    ("query", grid(["t"], [("[a] Eqv [b]", "c")]), ["LOGICAL_OPERATOR_NOT_IN_SQL"]),
    ("query", grid(["t"], [("[a]", "b")], where="[a]=[Forms]![f]![x]"), ["UI_REFERENCE_BECOMES_PARAMETER"]),
    ("query", grid(["t"], [("[CurrentProject].[Path]", "b")]), ["ACCESS_OBJECT_MODEL_REFERENCE"]),
    ("query", grid(["t"], [("Environ('x')", "b")]), ["ACCESS_RUNTIME_FUNCTION"]),
    ("query", grid(["t"], [("1 +", "b")]), ["EXPRESSION_PARSE_FAILED"]),
    ("query", grid(["t"], [("InStr(1,[a],'x')", "b")]), ["FUNCTION_REWRITE_INCOMPLETE"]),
    ("query", grid(["t"], ["t.a"], option=16, top=5), ["TOP_CLAUSE_IS_DIALECT_SPECIFIC"]),
    ("query", grid(["t", "u"], ["t.a"]), ["IMPLICIT_CROSS_JOIN"]),
    ("query", grid(["t"], ["t.a"], option=64), ["QUERY_OPTION_BITS_NOT_MAPPED"]),
    ("query", grid(["t", "u"], ["t.a"], joins=[("t", "u", "t.a=u.a", 9)]), ["JOIN_FLAG_NOT_MAPPED"]),
    ("query", grid(["t"], ["t.a"], operation=7), ["QUERY_OPERATION_CODE_NOT_MAPPED", "NON_SELECT_QUERY_SQL_NOT_GENERATED"]),
    ("query", stored("SELECT a FROM t UNION SELECT b FROM u"), ["STORED_SQL_NOT_RE_PARSED"]),
    ("query", 'dbMemo "SQL" ="SELECT 1"\ndbMemo "Connect" ="ODBC;DSN=x"\n', ["PASS_THROUGH_QUERY_TARGETS_EXTERNAL_SERVER"]),
    ("table", _XSD.format(name="t", columns='<xsd:element name="a" od:jetType="strange"/>'), ["JET_FIELD_TYPE_NOT_MAPPED"]),
    ("table", "<x/>", ["TABLE_ELEMENT_NOT_FOUND"]),
    ("table", "<x", ["SEMANTIC_PARSE_FAILED"]),
    ("macro", 'Begin\n Action ="Beep"\nEnd\n', ["MACRO_STORED_AS_FLAT_ACTION_LIST", "MACRO_ACTION_UI_NOT_TRANSLATABLE"]),
    ("macro", 'Begin\n Action ="NoSuchAction"\nEnd\n', ["MACRO_STORED_AS_FLAT_ACTION_LIST", "MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE"]),
    ("macro", 'Begin\n Comment ="_AXL:<x"\nEnd\n', ["MACRO_AXL_NOT_PARSED", "MACRO_STORED_AS_FLAT_ACTION_LIST"]),
    ("datamacro", "<DataMacros><DataMacro Event='AfterInsert'><Statements><Odd/></Statements></DataMacro></DataMacros>", ["MACRO_ELEMENT_NOT_RECOGNISED"]),
    ("form", 'Begin Form\n OnLoad ="[Embedded Macro]"\nEnd\n', ["EMBEDDED_MACRO_BODY_NOT_IN_TEXT_DEFINITION"]),
    ("form", "Operation =1\n", ["OBJECT_BLOCK_NOT_FOUND"]),
    ("relationships", "<x", ["RELATIONSHIP_XML_NOT_PARSED"]),
    *[("module", f"Sub A()\n  {line}\nEnd Sub\n", [code]) for line, code in (('MsgBox "x"', "VBA_INTERACTIVE_DIALOG"), ('Shell "x"', "VBA_STARTS_EXTERNAL_PROCESS"), ('Set x = CreateObject("y")', "VBA_AUTOMATION_OBJECT"), ('SendKeys "x"', "VBA_SENDS_KEYSTROKES"), ('Kill "x"', "VBA_FILE_SYSTEM_ACCESS"), ("x = Environ(1)", "VBA_HOST_ENVIRONMENT"), ("Application.Quit", "VBA_ACCESS_APPLICATION_OBJECT"), ("DoCmd.Beep", "VBA_DRIVES_ACCESS_UI"))],
    ("module", 'Declare Function F Lib "x" ()\n', ["VBA_DECLARES_EXTERNAL_LIBRARY"]),
]


@register("finding_codes", f"SELECT CAST(c_custkey AS VARCHAR) AS path, code AS reason_code FROM customer JOIN (VALUES {', '.join(f'({i}, {c!r})' for i, (_, _, codes) in enumerate(_CODED) for c in codes)}) t(i, code) ON c_custkey % {len(_CODED)} = i")
def _(spark, sf_dir):
    """A part of each sort a customer, by its key."""
    texts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text")) for kind, text, _ in _CODED])
    chosen = dealt(_keys(spark, sf_dir, "customer", "c_custkey")).select(F.col("c_custkey").cast("string").alias("path"), F.get(texts, (F.col("c_custkey") % len(_CODED)).cast("int")).alias("p"))
    return convert_parts(chosen.select("path", F.lit("x").alias("object"), "p.kind", "p.text"), "finding").findings().select("path", "reason_code").distinct()

