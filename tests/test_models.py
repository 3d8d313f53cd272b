"""Schemas, macros, forms, module code, packages, binary catalogs and their operators."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gridspark.catalogue_packages import database_of
from gridspark.operators import constraints, graph, names
from gridspark.plans.textformat import parse_text
from gridspark.sources import catalogs, forms, inventory, macros, packages, schema, vba
from gridspark.streaming import ingestion

XSD = """<?xml version="1.0" encoding="UTF-8"?>
<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:od="urn:schemas-microsoft-com:officedata">
<xsd:element name="Kegs"><xsd:annotation><xsd:appinfo><od:index index-name="PrimaryKey" index-key="KegID " primary="yes" unique="yes"/></xsd:appinfo></xsd:annotation>
<xsd:complexType><xsd:sequence>
<xsd:element name="KegID" od:jetType="autonumber" od:autoUnique="yes" od:nonNullable="yes"/>
<xsd:element name="Note" od:jetType="text"><xsd:annotation><xsd:appinfo><od:fieldProperty name="DefaultValue" value="Now()"/></xsd:appinfo></xsd:annotation>
<xsd:simpleType><xsd:restriction base="xsd:string"><xsd:maxLength value="50"/></xsd:restriction></xsd:simpleType></xsd:element>
<xsd:element name="Qty" od:jetType="longinteger" od:nonNullable="yes"><xsd:annotation><xsd:appinfo><od:fieldProperty name="ValidationRule" value="&gt;0"/></xsd:appinfo></xsd:annotation></xsd:element>
<xsd:element name="Files" od:jetType="complex"/>
</xsd:sequence></xsd:complexType></xsd:element></xsd:schema>"""
AXL = 'xmlns="http://schemas.microsoft.com/office/accessservices/2009/11/application"'


def test_table_schema():
    t = schema.read_table(XSD, "Kegs")
    assert t.primary_key == ["KegID"]
    assert {c.name: c.sql_type for c in t.columns} == {"KegID": "INTEGER", "Note": "VARCHAR(50)", "Qty": "INTEGER", "Files": None}
    assert "FIELD_TYPE_HAS_NO_PORTABLE_EQUIVALENT" in {f.reason_code for f in t.findings}
    ddl = t.ddl()
    for part in ("CREATE TABLE Kegs", "PRIMARY KEY (KegID)", "DEFAULT CURRENT_TIMESTAMP", "CHECK (Qty > 0)", "KegID INTEGER NOT NULL"):
        assert part in ddl
    assert t.struct().names == ["KegID", "Note", "Qty"] and "Files" in t.struct(opt_in=True).names
    with pytest.raises(ValueError):
        schema.read_table('<!DOCTYPE x [<!ENTITY a "b">]><x/>', "x")


def test_relationships():
    row = "<MSysRelationships><grbit>4352</grbit><szColumn>{}</szColumn><szObject>Tasters</szObject><szReferencedColumn>{}</szReferencedColumn><szReferencedObject>Breweries</szReferencedObject><szRelationship>FK</szRelationship></MSysRelationships>"
    (r,) = schema.read_relationships(f"<dataroot>{row.format('A', 'X')}{row.format('B', 'Y')}</dataroot>")
    assert r.enforced and r.cascade_update and r.cascade_delete and r.child_columns == ["A", "B"]
    assert "FOREIGN KEY (A, B) REFERENCES Breweries (X, Y) ON UPDATE CASCADE ON DELETE CASCADE" in r.ddl()


def test_unenforced_relationship_has_no_orphans(spark):
    child, parent = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(2,)], "k int")
    rel = schema.Relationship("r", "c", "p", ["k"], ["k"], 0)
    assert [r.k for r in constraints.orphans(child, parent, rel).collect()] == [1]
    assert constraints.orphans(child, parent, schema.Relationship("r", "c", "p", ["k"], ["k"], 2)).count() == 0


def test_macros():
    xml = f"""<DataMacros {AXL}><DataMacro Event="BeforeChange"><Statements><Comment>x</Comment><ConditionalBlock><If><Condition>[IsInsert]</Condition><Statements>
    <Action Name="SetField"><Argument Name="Field">A</Argument><Argument Name="Value">Now()</Argument></Action></Statements></If><Else><Statements/></Else></ConditionalBlock></Statements></DataMacro></DataMacros>"""
    m = macros.read_data_macros(xml, "Kegs")
    (h,) = m.handlers
    assert (h.timing, h.operation) == ("before", "insert_or_update") and m.translated
    assert [b[0] for b in h.statements[1].branches] == ["if", "else"] and h.statements[1].branches[1][2] == []
    flat = 'Begin\n Condition ="[X]=1"\n Action ="OpenForm"\n Argument ="frmA"\nEnd\nBegin\n Action ="RunCode"\n Argument ="Startup()"\nEnd\n'
    m = macros.read_macro(parse_text(flat), "mcr")
    assert m.representation == "legacy_action_list" and not m.translated and m.census() == {"system": ["RunCode"], "ui": ["OpenForm"]}
    assert m.handlers[0].statements[0].condition == "[X]=1"
    axl = f'<UserInterfaceMacro {AXL}><Statements><Action Name="Beep"/></Statements></UserInterfaceMacro>'.replace('"', '\\"')
    assert macros.read_macro(parse_text(flat + f'Begin\n Comment ="_AXL:{axl}"\nEnd\n'), "mcr").representation == "axl"
    assert {k: len(v.split()) for k, v in macros.ACTIONS.items()} == {"data": 12, "control": 10, "ui": 48, "system": 26}


FORM = """Begin Form
 RecordSource ="qryKegs"
 OnLoad ="[Event Procedure]"
 OnCurrent ="mcrRefresh"
 Begin
  Begin Label
  End
  Begin FormHeader
   Name ="H"
   Begin
    Begin Label
     Name ="lbl"
     Width =2000
    End
   End
  End
  Begin Section
   Name ="D"
   Begin
    Begin ComboBox
     Name ="cbo"
     RowSourceType ="Table/Query"
     RowSource ="SELECT ID FROM qryTasters"
     AfterUpdate ="[Event Procedure]"
    End
    Begin TextBox
     Name ="txt"
     ControlSource ="=Nz([Amount],0)*1.1"
    End
    Begin ListBox
     Name ="lst"
     RowSourceType ="Value List"
     RowSource ="A;B"
    End
    Begin Subform
     Name ="sub"
     SourceObject ="Form.lines"
     LinkChildFields ="KegID"
     LinkMasterFields ="KegID"
    End
    Begin CustomControl
     Name ="ax"
    End
   End
  End
 End
End
"""


def test_forms():
    m = forms.read_form(FORM, "frm")
    assert m.sections == ["FormHeader", "Section"] and "Label" in m.style_defaults
    assert {"qryKegs", "qryTasters"} <= set(m.dependencies)
    assert {("OnLoad", "Form_Load"), ("AfterUpdate", "cbo_AfterUpdate")} <= {(e.event, e.handler) for e in m.events}
    assert next(e for e in m.events if e.event == "OnCurrent").handler_kind == "macro_object"
    by = {c.name: c for c in m.controls}
    assert by["txt"].bindings[0].sql == "COALESCE(Amount, 0) * 1.1" and by["lbl"].geometry["width"] == 2000
    assert by["sub"].bindings[0].link_child == ("KegID",)
    assert {"ROW_SOURCE_TYPE_NOT_A_QUERY", "CONTROL_TYPE_HAS_NO_PORTABLE_EQUIVALENT"} <= {f.reason_code for f in m.findings}
    assert forms.read_form("Begin Report\nEnd\n", "x").findings[0].reason_code == "OBJECT_BLOCK_NOT_FOUND"


CODE = '''Option Explicit
Private Const LIMIT As Long = 10

Public Function Total(ByVal items As Long, Optional ByVal rate As Double = 1.5) As Double
10        On Error GoTo Err_Handler
          Dim i As Long
20        For i = 1 To items
30            If i Mod 2 = 0 Then
40                Total = Total + i * _
                     rate ' a comment
50            ElseIf i > LIMIT Then
60                Exit For
70            Else
80                Total = Total - i
90            End If
100       Next i
110       Select Case items
              Case 0
120               MsgBox "none"
              Case Else
130               DoCmd.OpenForm "frmResult"
140       End Select
Exit_Handler:
150       Exit Function
Err_Handler:
160       Resume Exit_Handler
End Function

Private Sub Helper()
30        CurrentDb.Execute "UPDATE Kegs SET Paid = True": If a Then b = 1 Else b = 2
40        Total 3
End Sub
'''


def test_module_code():
    m = vba.read_module(CODE, "mod")
    assert [p.name for p in m.procedures] == ["Total", "Helper"] and any("LIMIT" in d for d in m.declarations)
    total, helper = m.procedures
    assert (total.kind, total.returns) == ("function", "Double") and total.parameters[1].optional and total.parameters[1].default == "1.5"
    assert total.statements[0].source == "On Error GoTo Err_Handler"
    loop = next(s for s in total.statements if s.type == "for")
    assert [a[0] for a in next(s for s in loop.statements if s.type == "if").arms] == ["if", "elseif", "else"]
    assert [a[0] for a in next(s for s in total.statements if s.type == "select_case").arms] == ["case", "else"]
    assert vba.metrics(total)["loops"] == 1 and vba.metrics(total)["cyclomatic_complexity"] == 7
    e = vba.effects(helper, {"Total", "Helper"})
    assert e["calls"] == ["Total"] and e["sql_literals"] == ["UPDATE Kegs SET Paid = True"] and e["data_access"]
    assert vba.effects(total)["docmd_targets"] == ["openform:frmResult"]
    assert [a[0] for a in helper.statements[1].arms] == ["if", "else"]
    assert {"VBA_DRIVES_ACCESS_UI", "VBA_INTERACTIVE_DIALOG"} <= set(vba.module_findings(m))


def test_control_flow():
    flow = vba.control_flow(vba.read_module(CODE, "mod").procedures[0])
    kinds = [n[1] for n in flow.nodes]
    assert kinds.count("start") == 1 and kinds.count("end") == 1 and kinds.count("loop") == 1
    labels = {e[2] for e in flow.edges}
    assert {"yes", "no", "loop_body", "loop_next", "loop_exit", "break", "Case 0", "Case Else", "on_error", "goto"} <= labels
    assert all(sum(1 for e in flow.edges if e[1] == n[0]) for n in flow.nodes if n[1] not in ("start", "label"))


def _package(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_packages(spark, tmp_path):
    good = _package([("template/template.xml", "<x/>"), ("template/database/objects/query1.txt", "Operation =1\n".encode("utf-16")), ("template/database/sampledata/a.xml", "x")])
    (tmp_path / "good.accdt").write_bytes(good)
    (tmp_path / "bad.accdt").write_bytes(_package([("template/template.xml", "<x/>"), ("../evil.txt", "x")]))
    (tmp_path / "none.accdt").write_bytes(b"nothing")
    (tmp_path / "bomb.accdt").write_bytes(_package([("template/template.xml", b"\0" * (2 << 20))]))
    entries = packages.read_packages(spark, f"file://{tmp_path}").cache()
    assert {r.diagnostic for r in entries.filter("diagnostic is not null").collect()} == {"UNSAFE_PACKAGE_PATH", "INVALID_ACCDT_PACKAGE", "PACKAGE_LIMIT_EXCEEDED"}
    (part,) = packages.object_parts(entries).collect()
    assert (part.kind, part.object, part.encoding, part.text) == ("query", "1", "utf-16", "Operation =1\n")
    assert {r.feature: (r.entries, r.objects) for r in packages.features(entries).collect()} == {"package_metadata": (1, None), "table_data": (1, None), "target_generation": (0, packages.object_parts(entries).count())}
    stream = ingestion.stream_packages(spark, f"file://{tmp_path}")
    assert stream.isStreaming
    query = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("arrived").count() == entries.count()


def test_binary_catalogs(spark, tmp_path):
    objects = [("Kunden", 1), ("MSysObjects", 1), ("~sq_f", 5), ("frm", -32768)]
    old = database_of(catalogs.OLD, objects)
    new = database_of(catalogs.NEW, objects)
    for content, kind in ((old, "jet3"), (new, "jet4")):
        found, rows = catalogs.read_catalog(content)
        assert found == kind and [(r.name, r.kind) for r in rows] == [("Kunden", "table"), ("MSysObjects", "table"), ("~sq_f", "query"), ("frm", "form")]
    assert catalogs.compressed_text(b"\xff\xfeab\xff\xfe\x42\x30\xff\xfec") == "abあc"
    (tmp_path / "a.mdb").write_bytes(old)
    (tmp_path / "b.accdb").write_bytes(bytes(8192))
    rows = packages.read_catalogs(spark, f"file://{tmp_path}").collect()
    assert {(r.name, r.hidden) for r in rows if r.diagnostic is None} == {("Kunden", False), ("~sq_f", True), ("frm", False)}
    assert sum(r.diagnostic is not None for r in rows) == 1
    with pytest.raises(catalogs.CatalogError):
        catalogs.read_catalog(old[:-1])


def _corpus(root, **files):
    for place, content in files.items():
        folder = root / place
        folder.mkdir(parents=True)
        (folder / "object_inventory.json").write_text(content if isinstance(content, str) else json.dumps(content))
    return f"file://{root}"


DATABASE = {"file": "kunden.mdb", "format": "MS Jet 4 database", "counts": {"Table": 5, " Table (Linked)": 1, "Hidden Query (~sq_)": 2}, "objects": [{"name": "t", "kind": "Table"}, {"name": "~q", "kind": "hidden query"}]}
LISTS = {"counts": {"Form": 2, "Data Macro": 1}, "tables": [], "queries": [], "forms": ["a", "b"], "reports": [], "macros": [], "data_macros": ["m"], "modules": []}


def test_inventory(spark, tmp_path):
    from gridspark.operators.coverage import reconcile

    path = _corpus(tmp_path, one={"sample": "s1", "databases": [DATABASE, {**DATABASE, "file": "leer.accdb", "format": "ACE", "counts": {}, "objects": []}]}, two={"sample": "s2", **LISTS})
    (tmp_path / "two" / "Original").mkdir()
    (tmp_path / "two" / "a.accdt").write_bytes(b"PK")
    with pytest.raises(inventory.InventoryError, match="missing or ambiguous"):
        (tmp_path / "two" / "b.accdt").write_bytes(b"PK")
        inventory.read_inventories(spark, path).checked()
    (tmp_path / "two" / "b.accdt").unlink()
    corpus = inventory.read_inventories(spark, path).checked()
    assert {(r.sample, r.artifact, r.format_family) for r in corpus.artifacts().collect()} == {("s1", "kunden.mdb", "jet4"), ("s1", "leer.accdb", "ace"), ("s2", "a.accdt", "accdt")}
    assert [(r.sample, r.bucket, r.name) for r in corpus.objects().orderBy("sample", "ordinal").collect()] == [("s1", "table", "t"), ("s1", "query_hidden", "~q"), ("s2", "form", "a"), ("s2", "form", "b"), ("s2", "macro_data", "m")]
    assert {(r.artifact, r.bucket): r.weight for r in corpus.count_only().collect()} == {("kunden.mdb", "table"): 4, ("kunden.mdb", "table_linked"): 1, ("kunden.mdb", "query_hidden"): 1}
    rows = reconcile(corpus.counts().select("sample", "artifact", "bucket", "declared"), corpus.objects(), ["sample", "artifact", "bucket"]).collect()
    assert not any(r.over_named for r in rows) and sum(r.residual for r in rows) == 6
    keys = spark.createDataFrame([("Linked Table",), ("Data Macro (axl)",), ("x",)], "key string")
    assert [r[0] for r in keys.select(inventory.bucket_column()).collect()] == ["table_linked", "macro_data", None]


def test_inventory_faults(spark):
    change = lambda **x: {"sample": "s", "databases": [{**DATABASE, **x}]}
    cases = {
        "{": "no JSON",
        "[]": "not an object",
        '{"sample": ""}': "sample",
        '{"sample": "s"}': "unknown shape",
        '{"sample": "s", "databases": {}}': "unknown shape",
        json.dumps(change(file=None)): "file",
        json.dumps(change(format="dBase")): "dbase",
        json.dumps(change(counts=[])): "counts",
        json.dumps(change(counts={"Tables of all sorts": 1})): "unknown",
        json.dumps(change(counts={"Table": -1})): "non-negative",
        json.dumps(change(counts={"Table": True})): "non-negative",
        json.dumps(change(counts={"Table": "3"})): "non-negative",
        json.dumps(change(objects={})): "list",
        json.dumps(change(objects=[{"name": "x", "kind": "gadget"}])): "kind",
        json.dumps(change(objects=[{"kind": "Form"}])): "name",
        json.dumps(change(counts={"Table": 0, "Hidden Query": 1})): "1 named",
        json.dumps({"sample": "s", "databases": [DATABASE, DATABASE]}): "twice",
        json.dumps({"sample": "s", **LISTS, "forms": "a"}): "list",
        json.dumps({"sample": "s", **LISTS, "forms": ["a"]}): "2 declared, 1 named",
    }
    rows = spark.createDataFrame([(str(i), text) for i, text in enumerate(cases)], "source string, content string")
    found = {}
    for r in inventory.read_units(rows).faults().collect():
        found.setdefault(r.source, []).append(r.fault)
    for i, word in enumerate(cases.values()):
        assert any(word in f for f in found[str(i)]), (word, found.get(str(i)))
    same = spark.createDataFrame([("a", json.dumps(change())), ("b", json.dumps(change()))], "source string, content string")
    assert [r.fault for r in inventory.read_units(same).faults().collect()] == ["the sample s is there twice"]
    with pytest.raises(inventory.InventoryError, match="no inventory"):
        inventory.read_units(same.limit(0)).checked()


@pytest.mark.parametrize(
    ("text", "name"),
    [(" Customer Name ", "customer_name"), ("USER-ID", "user_id"), ("  A   B  C  ", "a_b_c"), ("abc___def", "abc_def"), ("Price($)", "price"), ("", ""), ("---", ""), ("日本語 ABC", "abc"), (" \tA-\n-- B\r\nC\v-\fD ", "a_b_c_d"), ("one - _ -- two", "one_two"), ("a-@-b", "a_b"), ("café", "caf"), ("foo.bar/baz", "foobarbaz"), ("İD", "d"), (" A B ", "a_b")],
)
def test_normalized_names(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(names.normalized(F.col("t"))).first()[0] == name


def test_graph_on_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    assert {r.id: r.layer for r in graph.layers(links, nodes).collect()} == {"a": 0, "b": None, "c": None, "d": None}
    assert {r.id: r.depth for r in graph.neighbourhood(links, nodes.filter("id = 'd'"), 2).collect()} == {"d": 0, "c": 1, "b": 2}


def test_layers_with_cycles_as_one_node(spark):
    pairs = [("a", "e"), ("e", "d"), ("d", "c"), ("c", "e"), ("c", "f"), ("f", "h"), ("h", "g"), ("g", "f"), ("d", "h"), ("h", "i"), ("a", "i"), ("j", "j"), ("j", "k"), ("?", "a")]
    links, nodes = spark.createDataFrame(pairs, "src string, dst string").coalesce(1), spark.createDataFrame([(x,) for x in "acdefghijk"], "id string").coalesce(1)
    assert {r.id: r.component for r in graph.strong_components(links).collect()} == dict(zip("cdefgh", "cccfff", strict=True))
    assert {r.id: r.layer for r in graph.layers(links, nodes, cycles="component").collect()} == dict(zip("acdefghijk", (0, 1, 1, 1, 2, 2, 2, 3, 0, 1), strict=True))


def test_rates_and_windows_on_a_stream(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*20) as ts, 'u' as k from range(6)")
    assert ingestion.over_limit(events, "k", "ts", 2).count() == 4
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    query = ingestion.windowed_counts(stream, "ts", "k", "1 minute").writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("counted").collect()) == [3, 3]


def test_whole_package(spark, tmp_path):
    from gridspark.catalogue import grid
    from gridspark.sources.convert import artifact_identity, convert_packages

    objects = "template/database/objects/"
    module = "Option Compare Database\nSub Open_It()\n  DoCmd.OpenForm \"Main\"\n  CurrentDb.Execute \"DELETE * FROM Kegs\"\n  Helper\nEnd Sub\nFunction Helper()\nEnd Function\n"
    parts = [
        ("template/template.xml", "<x/>"),
        (objects + "tableKegs.xsd", XSD),
        (objects + "queryAll Kegs.txt", grid(["Kegs"], [("Helper([Kegs].[Qty])", "q")])),
        (objects + "formMain.txt", FORM.replace("qryKegs", "All Kegs") + "Option Compare Database\nSub Form_Load()\n  Helper\nEnd Sub\n"),
        (objects + "Macrobeep.txt", 'Begin\n Action ="Beep"\nEnd\n'),
        (objects + "moduleCode.txt", module),
        (objects + "datamacros/datamacrosKegs.axl", f'<DataMacros {AXL}><DataMacro Event="AfterInsert"><Statements><ForEachRecord><Data><Reference>Kegs</Reference></Data><Statements><Action Name="SetField"/></Statements></ForEachRecord></Statements></DataMacro></DataMacros>'),
        (objects + "query2.txt", "Operation =7\n"),
        (objects + "table2.xsd", '<!DOCTYPE x [<!ENTITY a "b">]><x/>'),
        (objects + "deeper/formStray.txt", "Begin Form\nEnd\n"),
        ("template/other/formStray.txt", "Begin Form\nEnd\n"),
        (objects + "form.txt", "Begin Form\nEnd\n"),
    ]
    (tmp_path / "one.accdt").write_bytes(_package(parts))
    (tmp_path / "two.accdt").write_bytes(_package([("template/template.xml", "<x/>"), (objects + "query1.txt", grid(["missing"], ["Helper(1)"]))]))
    made = convert_packages(spark, f"file://{tmp_path}")
    one = F.col("path").endswith("one.accdt")
    assert {(r.kind, r.object) for r in made.objects().filter(one).collect()} == {("table", "Kegs"), ("query", "All Kegs"), ("form", "Main"), ("macro", "beep"), ("module", "Code"), ("datamacro", "Kegs"), ("query", "2"), ("table", "2")}
    assert {(r.kind, r.object): r.translated for r in made.objects().filter(one & F.col("object").isin("beep", "2")).collect()} == {("macro", "beep"): False, ("query", "2"): False, ("table", "2"): False}
    codes = {(r.kind, r.object, r.reason_code) for r in made.findings().filter(one).collect()}
    assert {("query", "All Kegs", "USER_DEFINED_VBA_FUNCTION"), ("table", "2", "SEMANTIC_PARSE_FAILED"), ("query", "2", "QUERY_OPERATION_CODE_NOT_MAPPED"), ("module", "Code", "VBA_DRIVES_ACCESS_UI")} <= codes
    assert ("1", "UNKNOWN_FUNCTION") in {(r.object, r.reason_code) for r in made.findings().filter(~one).collect()}
    edges = {(r.src, r.dst, r.edge) for r in made.edges().collect()}
    assert edges == {
        ("query:all kegs", "table:kegs", "reads"),
        ("form:main", "query:all kegs", "reads"),
        ("form:main", "proc:main:form_load", "contains"),
        ("form:main", "proc:main:form_load", "handles"),
        ("module:code", "proc:code:open_it", "contains"),
        ("module:code", "proc:code:helper", "contains"),
        ("proc:code:open_it", "proc:code:helper", "calls"),
        ("proc:main:form_load", "proc:code:helper", "calls"),
        ("proc:code:open_it", "form:main", "opens"),
        ("proc:code:open_it", "table:kegs", "reads"),
        ("datamacro:kegs", "table:kegs", "trigger"),
    }
    kinds = {r.kind for r in made.records.filter("record = 'cfg_node'").select(F.col("fields")["kind"].alias("kind")).collect()}
    assert {"start", "end", "loop", "data", "ui"} <= kinds
    assert {r.kind: (r.objects, r.complete) for r in made.summary().filter(one & (F.col("kind") == "query")).collect()} == {"query": (2, 0)}
    rows = spark.createDataFrame([("s", "original/a", True), ("s", "b", True), ("t", "c", True), ("u", "d", True), ("u", "e", True)], "sample_id string, artifact_name string, is_candidate boolean")
    assert {r.sample_id: r.artifact_name for r in artifact_identity(rows).collect()} == {"s": "original/a", "t": "c", "u": None}


def test_json_is_written_with_sorted_keys(spark, tmp_path):
    from gridspark.sources.convert import write_json

    df = spark.createDataFrame([("x", 1, None)], "b string, a int, c string")
    write_json(df.coalesce(1), f"file://{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == '{"a":1,"b":"x","c":null}\n' and (tmp_path / "out" / "_SUCCESS").exists()


def test_documents_appear_whole_or_not_at_all(spark, tmp_path):
    from gridspark.sources import documents

    rows = spark.createDataFrame([("a/b c", {"z": 1, "y": 2}, [(2, None)]), ("d", None, None)], "name string, m map<string,int>, list array<struct<q:int,p:string>>")
    made = rows.withColumn("text", documents.json_of(rows))
    assert documents.write_documents(made, f"file://{tmp_path}/out", "name", "text") == 2
    read = lambda: {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")}
    before = read()
    assert before == {"a%2Fb+c.json": '{"list":[{"p":null,"q":2}],"m":{"y":2,"z":1},"name":"a/b c"}\n', "d.json": '{"list":null,"m":null,"name":"d"}\n'}
    bad = made.withColumn("text", F.when(F.col("name") == "d", F.raise_error(F.lit("no"))).otherwise("new"))
    with pytest.raises(Exception, match="no"):
        documents.write_documents(bad, f"file://{tmp_path}/out", "name", "text")
    assert read() == before
    with pytest.raises(ValueError):
        documents.write_documents(made.union(made), f"file://{tmp_path}/out", "name", "text")
    documents.write_documents(made.withColumn("text", F.lit("{}")).filter("name = 'd'"), f"file://{tmp_path}/out", "name", "text")
    assert read() == before | {"d.json": "{}\n"}
