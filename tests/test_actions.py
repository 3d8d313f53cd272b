"""Cascades, loops that carry values, triggers, scripts, cyclic graphs and streams with state: what the registered queries leave out."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions.columns import CompileError
from gridspark.operators import cascades, datamacros, graph, triggers
from gridspark.plans.scripts import Catalog, column_type
from gridspark.sources.macros import Handler, Statement, read_data_macros
from gridspark.sources.schema import CASCADE_DELETE, CASCADE_UPDATE, NOT_ENFORCED, Relationship
from gridspark.streaming import ingestion


def act(name, **arguments):
    return Statement("action", name, {k.replace("_", " "): v for k, v in arguments.items()})


def loop(*inner, where="[t].[keg]=[id]", table="taps"):
    return Statement("block", "ForEachRecord", {"Reference": table, "Alias": "t", "WhereCondition": where}, statements=list(inner))


@pytest.fixture(scope="module")
def tables(spark):
    kegs = spark.createDataFrame([(1, "Ale", 10), (2, "Bock", 20), (3, "a, b", None)], "id int, name string, size int")
    taps = spark.createDataFrame([(1, "x", 5), (1, "w", 7), (2, "y", None), (2, "z", 1)], "keg int, place string, n int")
    return {"kegs": kegs, "taps": taps}


def test_deletes_through_circles_and_composite_keys(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3), (None, 1)], "x int, y int")
    b = spark.createDataFrame([(1, 2, 9), (2, 1, 1), (3, 3, 3), (1, None, 4)], "ax int, ay int, k int")
    rules = [Relationship("ab", "b", "a", ["ax", "ay"], ["x", "y"], CASCADE_DELETE), Relationship("ba", "a", "b", ["x"], ["k"], CASCADE_DELETE), Relationship("off", "b", "a", ["k"], ["x"], CASCADE_DELETE | NOT_ENFORCED)]
    out = cascades.delete_through({"a": a, "b": b}, rules, "a", "x=2").tables
    # a (2,1) goes, so b (2,1,1) does, so all of a with x=1 do, so b (1,2,9) does
    assert sorted(map(tuple, out["a"].collect()), key=str) == [(3, 3), (None, 1)]
    assert sorted(map(tuple, out["b"].collect()), key=str) == [(1, None, 4), (3, 3, 3)]
    kept = cascades.delete_through({"a": a, "b": b}, [], "a", "y=1").tables["a"]
    assert kept.count() == 2


def test_key_changes_go_on_or_circle(spark):
    staff = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, boss int")
    rule = Relationship("boss", "staff", "staff", ["boss"], ["id"], CASCADE_UPDATE)
    out = cascades.change_keys({"staff": staff}, [rule], "staff", {"id": "id*10"}, "id<3").tables["staff"]
    assert sorted(map(tuple, out.collect()), key=str) == [(10, None), (20, 10), (3, 20)]
    blocked = cascades.change_keys({"staff": staff}, [Relationship("boss", "staff", "staff", ["boss"], ["id"], 0)], "staff", {"id": "id+5"}, "id=1").blocked
    assert [tuple(r) for r in blocked["boss"].collect()] == [(2, 1)]
    ring = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    circle = [Relationship("r", "ring", "other", ["a"], ["k"], CASCADE_UPDATE), Relationship("s", "other", "ring", ["k"], ["a"], CASCADE_UPDATE)]
    out = cascades.change_keys({"ring": ring, "other": spark.createDataFrame([(1,)], "k int")}, circle, "other", {"k": "k+100"}).tables
    assert sorted(map(tuple, out["ring"].collect())) == [(2, 2), (101, 1)] and out["other"].first().k == 101


def test_loops_that_carry(spark, tables):
    run = lambda *inner: datamacros.run_handler(Handler("AfterInsert", list(inner)), tables["kegs"], tables.__getitem__)
    back = lambda name: act("SetReturnVar", Name=name, Value=f"[{name}]")
    values = lambda out, c: {r.id: r[c] for r in out.rows.collect()}
    # a null among the terms makes the sum null; rows without matches keep their value
    assert values(run(act("SetLocalVar", Name="s", Value="CLng(1)"), loop(act("SetLocalVar", Name="s", Value="[s]+[t].[n]")), back("s")), "s") == {1: 13, 2: None, 3: 1}
    # products are folds, in the order of the records' columns (place w before x)
    product = run(act("SetLocalVar", Name="p", Value="CLng(1)"), loop(act("SetLocalVar", Name="p", Value="[p]*10+Nz([t].[n],0)")), back("p"))
    assert values(product, "p") == {1: 175, 2: 101, 3: 1}
    # two values that read each other, a value of one record alone, and an else branch
    pair = loop(act("SetLocalVar", Name="own", Value="Nz([t].[n],0)*2"), Statement("conditional", branches=[("if", "[own]>11", [act("SetLocalVar", Name="a", Value="[b]+[own]")]), ("else", None, [act("SetLocalVar", Name="b", Value="[b]+1")])]))
    out = run(act("SetLocalVar", Name="a", Value="CLng(0)"), act("SetLocalVar", Name="b", Value="CLng(5)"), pair, back("a"), back("b"))
    assert values(out, "a") == {1: 19, 2: 0, 3: 0} and values(out, "b") == {1: 6, 2: 7, 3: 5}
    # an error in a loop takes the row; the others go on
    out = run(loop(Statement("conditional", branches=[("if", '[t].[place]="z"', [act("RaiseError", Error_Description="no z")])])), act("SetField", Field="name", Value='"done"'))
    assert values(out, "name") == {1: "done", 3: "done"} and [(r.id, r.error) for r in out.errors.collect()] == [(2, "no z")]
    # a loop under a condition leaves other rows alone
    out = run(Statement("conditional", branches=[("if", "[id]=1", [loop(act("SetField", Field="size", Value="[size]+[t].[n]"))])]))
    assert values(out, "size") == {1: 22, 2: 20, 3: None}


def test_what_loops_refuse(tables):
    create = Statement("block", "CreateRecord", {"Reference": "taps"}, statements=[act("SetField", Field="n", Value="[s]")])
    for inner in ([act("SetField", Field="size", Value="[size]+1"), create], [loop(act("SetField", Field="size", Value="[size]+1"), table="kegs")], [act("RunDataMacro", MacroName="x"), act("SetField", Field="size", Value="0")]):
        with pytest.raises(CompileError):
            datamacros.run_handler(Handler("AfterInsert", [loop(*inner)]), tables["kegs"], tables.__getitem__)


def test_named_macros_and_their_parameters(tables):
    xml = '<DataMacros xmlns="http://schemas.microsoft.com/office/accessservices/2009/11/application"><DataMacro Name="Grow"><Statements><Action Name="SetField"><Argument Name="Field">size</Argument><Argument Name="Value">[size]+[by]</Argument></Action></Statements></DataMacro><DataMacro Event="AfterInsert"><Statements><Action Name="RunDataMacro"><Argument Name="MacroName">kegs.Grow</Argument><Parameters><Parameter Name="by" Value="[id]*100"/></Parameters></Action></Statements></DataMacro></DataMacros>'
    grow, start = read_data_macros(xml, "kegs").handlers
    out = datamacros.run_handler(start, tables["kegs"], tables.__getitem__, named={"kegs.Grow": grow}).rows
    assert out.columns == ["id", "name", "size"] and {r.id: r.size for r in out.collect()} == {1: 110, 2: 220, 3: None}
    again = Handler("again", [act("RunDataMacro", MacroName="again")])
    for named in ({}, {"again": again}):
        with pytest.raises(CompileError):
            datamacros.run_handler(again, tables["kegs"], tables.__getitem__, named=named)


def test_triggers_end_or_are_an_error(spark, tables):
    copy = Statement("block", "CreateRecord", {"Reference": "kegs"}, statements=[act("SetField", Field="id", Value="[id]-1")])
    until = Statement("conditional", branches=[("if", "[id]>0", [copy])])
    new = spark.createDataFrame([(3, "n", 1)], "id int, name string, size int")
    done = triggers.insert_rows(tables, {"kegs": [Handler("AfterInsert", [until])]}, "kegs", new)
    assert sorted(r.id for r in done.tables["kegs"].collect()) == [0, 1, 1, 2, 2, 3, 3] and [d for _, _, d in done.fired] == [1, 2, 3, 4]
    with pytest.raises(RecursionError):
        triggers.insert_rows(tables, {"kegs": [Handler("AfterInsert", [copy])]}, "kegs", new, most=3)
    refuse = Handler("BeforeChange", [Statement("conditional", branches=[("if", "[id]=3", [act("RaiseError", Error_Description="three")])])])
    done = triggers.insert_rows(tables, {"kegs": [refuse, Handler("AfterInsert", [copy])]}, "kegs", new)
    assert done.tables["kegs"].count() == 3 and done.errors["kegs"].first().error == "three"


def test_scripts(spark, tables, tmp_path):
    catalog = Catalog(spark, lambda name: tables[name.lower()], f"file://{tmp_path}/db")
    rows = catalog.run(["INSERT INTO kegs (id, name) VALUES (9, 'Gose')", "UPDATE kegs SET size = id WHERE size IS NULL", "SELECT id, size FROM KEGS WHERE id > 2 ORDER BY id"])
    assert [tuple(r) for r in rows.collect()] == [(3, 3), (9, 9)] and catalog("kegs").count() == 4 and tables["kegs"].count() == 3
    held = catalog("kegs")
    files = sorted(p.name for p in (tmp_path / "db").iterdir() if not p.name.endswith(".crc"))
    for bad in ("INSERT INTO kegs (id) VALUES (1, 2)", "DROP TABLE nothing", "CREATE TABLE kegs (a LONG)", "ALTER TABLE kegs ADD COLUMN size LONG", "CREATE TABLE t (a NOSUCHTYPE)", "CREATE INDEX i ON kegs (id)", "SELECT id INTO taps FROM kegs"):
        with pytest.raises(Exception):  # noqa: B017
            catalog.run(["DELETE FROM kegs", "CREATE TABLE fresh (a LONG)", bad])
        assert catalog("kegs").count() == 4
        assert sorted(p.name for p in (tmp_path / "db").iterdir() if not p.name.endswith(".crc")) == files  # nothing is left of it
    with pytest.raises(KeyError):
        catalog("fresh")
    catalog.run(["DROP TABLE kegs", "CREATE TABLE kegs (a DECIMAL(9,2), [b c] YESNO)"])
    assert catalog("kegs").dtypes == [("a", "decimal(9,2)"), ("b c", "boolean")] and held.count() == 4  # readers of before keep their rows
    assert Catalog(spark, lambda name: tables[name.lower()], f"file://{tmp_path}/db")("KEGS").columns == ["a", "b c"]
    assert column_type("VARCHAR (20) NOT NULL") == "string" and column_type("numeric") == "decimal(18,0)"


def test_two_scripts_at_once(spark, tables, tmp_path):
    catalog = Catalog(spark, lambda name: tables[name.lower()], f"file://{tmp_path}/db")

    def meanwhile():
        yield "DELETE FROM kegs WHERE id = 1"
        Catalog(spark, lambda name: tables[name.lower()], f"file://{tmp_path}/db").run(["DELETE FROM kegs WHERE id = 2"])
        yield "DELETE FROM kegs WHERE id = 3"

    with pytest.raises(RuntimeError):
        catalog.run(meanwhile())
    assert sorted(r.id for r in catalog("kegs").collect()) == [1, 3]


def test_cycles_are_cut_and_layered(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "b"), ("d", "d"), ("p", "q"), ("q", "p")]
    links, nodes = spark.createDataFrame(pairs, "src string, dst string").coalesce(1), spark.createDataFrame([(c,) for c in "abcdxpqz"], "id string").coalesce(1)
    forward = {tuple(r) for r in graph.forward_links(links).collect()}
    assert forward == {("b", "c"), ("c", "a"), ("c", "d"), ("x", "b"), ("p", "q")}  # b is where the ring is entered
    assert {r.id: r.layer for r in graph.layers(links, nodes, cycles="cut").collect()} == {"x": 0, "b": 1, "c": 2, "a": 3, "d": 3, "p": 0, "q": 1, "z": 0}


def _crossings(edges, place):
    return sum((place[a] - place[c]) * (place[b] - place[d]) < 0 for i, (a, b) in enumerate(edges) for c, d in edges[:i])


def test_sweeps_take_crossings_away(spark):
    rng = random.Random(5)
    edges = [(f"u{i}", f"v{9 - i}") for i in range(10)] + [(f"u{i}", f"v{rng.randrange(10)}") for i in range(3)]
    links = spark.createDataFrame(edges, "src string, dst string").coalesce(1)
    layered = spark.createDataFrame([(f"{c}{i}", n) for n, c in enumerate("uv") for i in range(10)], "id string, layer int").coalesce(1)
    before, after = ({r.id: r.place for r in graph.places(links, layered, sweeps).collect()} for sweeps in (0, 4))
    assert _crossings(edges, after) < _crossings(edges, before) / 2 and sorted(after.values()) == sorted(before.values())


def test_the_limiter_as_a_stream(spark, tmp_path):
    start, rng = dt.datetime(2024, 1, 1), random.Random(2)
    at = lambda s: start + dt.timedelta(seconds=s)
    times = sorted(rng.randrange(600) for _ in range(150))
    events = [(at(t), f"u{t % 2}") for t in times] + [(at(300), "u0")] * 4
    late = rng.sample(events, 20)  # come a file later than their neighbours, within the bound
    files = [[e for e in events if e not in late and lo <= (e[0] - start).seconds < lo + 60] + [e for e in late if lo - 60 <= (e[0] - start).seconds < lo] for lo in range(0, 720, 60)]
    files.append([(at(5), "u0")] * 50)  # too late: not counted
    files += [[(at(2000 + i), "end")] for i in range(3)]  # moves the watermark on
    schema = "ts timestamp, k string"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows or [(at(1990), "end")][:0], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i:02}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"file://{tmp_path}")
    query = ingestion.over_limit_stream(stream, "k", "ts", 10).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.k, r.second, r.in_window) for r in spark.table("limited").collect())
    counted = [e for f in files[:12] for e in f]
    table = spark.createDataFrame(counted, schema)
    want = sorted({(r.k, int(r.s), r.in_window) for r in ingestion.over_limit(table, "k", "ts", 10).withColumn("s", F.unix_timestamp("ts")).collect()})
    assert got == want and want


def test_packages_once(spark, tmp_path):
    import io
    import zipfile

    def package(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("template/template.xml"), "<x/>")
            z.writestr(zipfile.ZipInfo("template/database/objects/queryA.txt"), text)
        return out.getvalue()

    for name, text in (("a", "Operation =1\n"), ("b", "Operation =1\n"), ("c", "Operation =2\n")):
        (tmp_path / f"{name}.accdt").write_bytes(package(text))
    stream = ingestion.stream_packages(spark, f"file://{tmp_path}", once="1 day")
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    texts = sorted(r.text for r in spark.table("once").filter("name like '%queryA%'").collect())
    assert texts == ["Operation =1\n", "Operation =2\n"]
