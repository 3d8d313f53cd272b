"""Work is dealt by the number of rows, not by the bytes of a file; frames hold several files."""

import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import gridspark.catalogue_models  # noqa: F401  registers its queries
import gridspark.catalogue_packages  # noqa: F401
from gridspark.catalogue import QUERIES
from gridspark.plans.tables import dealt
from gridspark.sources import convert, packages

SF = "/root/testdata/sf0.01"


def _tasks(rows) -> int:
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def _package(n: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr(packages.TEMPLATE, "<x/>")
        for i in range(n):
            package.writestr(f"template/{i}.txt", "x")
    return out.getvalue()


def _frames(df, files: list[tuple[str, bytes]]) -> list[pd.DataFrame]:
    """The frames that the function behind `df(files)` hands over for one batch."""

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, work, _):  # noqa: N802
            self.frames = list(work(iter([pd.DataFrame(files, columns=["path", "content"])])))
            return self

    return df(Files()).frames


def test_packages_share_frames(monkeypatch):
    files = [(str(i), _package(3)) for i in range(50)]
    frames = _frames(packages.package_entries, files)
    assert len(frames) == 1 and len(frames[0]) == 200
    monkeypatch.setattr(packages, "BATCH_ROWS", 10)
    cut = _frames(packages.package_entries, files)
    assert len(cut) == 25 and pd.concat(cut, ignore_index=True).equals(frames[0])


@pytest.mark.parametrize("name", ["package_limits", "package_diagnostics", "package_hashes", "input_status_in_memory", "catalog_objects", "catalog_diagnostics", "finding_codes", "vba_metrics_corpus"])
def test_keys_of_a_small_file_are_dealt(spark, name, monkeypatch):
    """The rows that cost the work come from more than one task, though their file is one for Spark."""
    dealt, plain = [], DataFrame.mapInPandas

    def watched(self, *args, **kwargs):
        dealt.append(self)
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInPandas", watched)
    QUERIES[name](spark, SF)
    assert _tasks(dealt[0]) > 1


def test_inventories_are_read_once(spark):
    """The views of an inventory read its written units, of many tasks; before, each went through all texts again."""
    from gridspark.catalogue_packages import _inventory
    from gridspark.sources import inventory

    units = _inventory(spark, SF).units
    assert len(units.inputFiles()) > 1
    assert sorted(map(tuple, QUERIES["inventory_faults"](spark, SF).collect())) == sorted((str(k), _fault(k)) for k in range(0, spark.read.parquet(f"{SF}/customer.parquet").count(), 50))
    none = spark.createDataFrame([("a", '{"sample": "s", "databases": []}')], "source string, content string")
    assert inventory.read_units(none).units.count() == 0


def _fault(k: int) -> str:
    return {0: "the file is no JSON", 50: "count key 'Gadget' is unknown", 100: "format 'paper 1' is unknown"}.get(k % 200, f"macro of {k}.mdb: 0 declared, 1 named")


def test_tasks_of_dealt_rows_are_small(spark):
    """A task's files, which Spark hands over together, do not grow with the input."""
    assert dealt(spark.range(30_000)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 1_000


def test_records_lie_apart_and_share_bounded_frames(spark, monkeypatch):
    """A view reads the records of its own sort only; frames hold several parts, but not a whole batch."""
    works, plain = [], DataFrame.mapInPandas

    def watched(self, work, schema):
        works.append(work)
        return plain(self, work, schema)

    monkeypatch.setattr(DataFrame, "mapInPandas", watched)
    parts = [("a", f"c{i}", "module", "Sub A()\n  DoCmd.Beep\nEnd Sub\n") for i in range(50)]
    conversion = convert.convert_parts(spark.createDataFrame(parts, "path string, object string, kind string, text string"))
    assert conversion.findings().count() == 50 and conversion.objects().count() == 50
    assert all("/record=" in f for f in conversion.records.inputFiles())
    batch = pd.DataFrame([(*p, None) for p in parts], columns=["path", "object", "kind", "text", "known"])
    whole = list(works[-1](iter([batch])))
    monkeypatch.setattr(packages, "BATCH_ROWS", 20)
    cut = list(works[-1](iter([batch])))
    assert len(whole) == 1 and len(cut) > 10 and pd.concat(cut, ignore_index=True).equals(whole[0])


def test_features_read_packages_once(spark):
    assert QUERIES["package_features"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 2


def test_parsed_parts_are_dealt_by_their_number(spark, monkeypatch):
    """A task's parts do not grow with the input; before, there were as many tasks as cores, however many parts."""
    monkeypatch.setattr(convert, "MOST_PARTS", 2)
    parts = [(f"p{i}", "c", "module", f"Sub A{i}()\n  x = A{i}()\nEnd Sub\n") for i in range(200)]
    conversion = convert.convert_parts(spark.createDataFrame(parts, "path string, object string, kind string, text string"))
    tasks = {f.rpartition("/")[2].split("-")[1] for f in conversion.records.inputFiles()}
    assert len(tasks) > 2 * spark.sparkContext.defaultParallelism
    assert conversion.objects().count() == conversion.procedures().count() == 200
    assert {tuple(r) for r in conversion.procedures().select("path", "name").collect()} == {(f"p{i}", f"A{i}") for i in range(200)}


@pytest.mark.parametrize("name", ["input_status", "input_status_in_memory"])
def test_inputs_are_read_once(spark, name):
    """Files are made once and read once; before, once for each of packages, databases and others."""
    assert QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 2


def test_status_of_odd_inputs(spark):
    """A database of system objects alone has a row, too; a package without objects fails; paths need no suffix."""
    from gridspark.catalogue_packages import database_of, package_of
    from gridspark.sources import catalogs

    files = [("a/S.MDB", database_of(catalogs.OLD, [("MSysObjects", 1), ("~TMPCLP1", 1)])), ("b.accdb", database_of(catalogs.NEW, [("t", 1), ("q", 5), ("MSysX", 1)])), ("c.accdt", _package(2)), ("d.ACCDT", package_of(7)), ("e.mdb", b""), ("f", b"x")]
    rows = spark.createDataFrame(files, "path string, content binary")
    other = ("f", None, "unsupported", "UNSUPPORTED_INPUT_FORMAT", 0)
    packed = [("c.accdt", "accdt", "failed", "NO_ACCESS_OBJECT_DEFINITIONS", 0), ("d.ACCDT", "accdt", "converted", None, 8)]
    later, refused = "BINARY_OBJECT_DEFINITION_EXTRACTION_NOT_IMPLEMENTED", "BINARY_INPUT_REQUIRES_A_FILE_PATH"
    read = [("a/S.MDB", "jet3", "discovered", later, 0), ("b.accdb", "jet4", "discovered", later, 2), ("e.mdb", None, "unsupported", "BINARY_CATALOG_NOT_READABLE", 0)]
    assert sorted(map(tuple, packages.input_status(rows).collect())) == sorted([*read, *packed, other])
    assert sorted(map(tuple, packages.input_status(rows, in_memory=True).collect())) == sorted([*((p, "jet_or_ace_binary", "unsupported", refused, 0) for p in ("a/S.MDB", "b.accdb", "e.mdb")), *packed, other])


CODED = [("p", "Code", "module", 'Sub A()\n  DoCmd.OpenForm "Main"\n  B\nEnd Sub\nSub B()\nEnd Sub\n'), ("p", "Main", "form", "Begin Form\nEnd\n"), ("q", "None", "module", "")]


def test_conversions_hand_over_only_the_records_that_are_read(spark):
    """A report needs objects and findings; before, the control flow of all procedures was written for it, too."""
    parts = spark.createDataFrame(CODED, "path string, object string, kind string, text string")
    whole, some = convert.convert_parts(parts), convert.convert_parts(parts, *convert.OF_OBJECTS)
    sorts = lambda c: {f.partition("/record=")[2].partition("/")[0] for f in c.records.inputFiles()}
    assert sorts(some) == {"object", "finding"} < sorts(whole)
    for view in ("objects", "findings", "summary", "corpus_report"):
        assert sorted(map(str, getattr(some, view)().collect())) == sorted(map(str, getattr(whole, view)().collect()))
    with pytest.raises(ValueError, match="cfg_edge"):
        some.cfg_edges()
    assert convert.convert_parts(parts, "relationship").relationships().count() == 0


def test_names_of_procedures_need_no_statements(monkeypatch):
    from gridspark.sources import vba

    text = "Option Explicit\nSub A(): x = 1: y = \"'\" ' End Sub\nEnd Sub\nPrivate Function B() As Long\n If x Then\nEnd Function\nSub Open_()\n x\n"
    names = [p.name for p in vba.read_module(text, "m").procedures]
    monkeypatch.setattr(vba, "_Tree", None)
    assert vba.procedure_names(text) == names == ["A", "B"]


def test_payloads_are_grouped_once(spark):
    """The lists of a payload are grouped by one shuffle; before, each had its own, and a join. A list of nothing is null."""
    conversion = convert.convert_parts(spark.createDataFrame(CODED, "path string, object string, kind string, text string"), *convert.OF_PAYLOAD)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(conversion.payload()) == joins(conversion.objects()) + joins(conversion.edges())
    found = {r.path: json.loads(r.payload) for r in conversion.payload().collect()}
    assert {c for c, v in found["q"].items() if v is None} == {"procedures", "flow", "edges"}
    assert [len(found["p"][c]) for c in ("objects", "procedures", "nodes")] == [2, 2, 4]
    assert [(e["src"], e["dst"], e["edge"]) for e in found["p"]["edges"]] == sorted([("module:code", "proc:code:a", "contains"), ("module:code", "proc:code:b", "contains"), ("proc:code:a", "form:main", "opens"), ("proc:code:a", "proc:code:b", "calls")])
