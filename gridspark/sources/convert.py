"""Whole packages converted: one parse of every part, then DataFrames of what was found.

Parts are parsed side by side; a part yields records of a few types with their
fields in a map. The records are written once, and objects, findings, procedures,
control flow, references and edges are views of them. Names resolve within a package.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.checkpoints import written
from gridspark.functions.registry import Finding
from gridspark.operators import coverage
from gridspark.operators.graph import KIND_ORDER, OPENERS
from gridspark.plans.model import read_query, source_tables
from gridspark.plans.textformat import parse_text

from . import documents, flow, forms, macros, schema, vba
from .packages import object_parts, read_packages, together

RECORDS = "path string, object string, kind string, record string, ordinal long, fields map<string,string>"
#: Macro arguments that name an object, with its kind.
ARGUMENT_KINDS = {"FormName": "form", "ReportName": "report", "QueryName": "query", "TableName": "table", "MacroName": "macro", "ObjectName": ""}
#: Sorts of records that views read: those of objects, of edges, and of all that a payload holds.
OF_OBJECTS = ("object", "finding")
OF_EDGES = ("object", "procedure", "reference", "call", "handler")
OF_PAYLOAD = (*OF_EDGES, "finding", "cfg_edge")
#: Parts that a task parses, on average; those of one package stay together.
MOST_PARTS = 10_000

Record = tuple[str, dict[str, str]]


def _findings(found: list[Finding]) -> Iterator[Record]:
    for f in found:
        yield "finding", {"reason_code": f.reason_code, "detail": f.detail, "note": f.note}


def _reference(target: str, edge: str, hint: str = "", source: str = "") -> Record:
    return "reference", {"target": target, "edge": edge, "hint": hint, "procedure": source}


def _graph(owner: str, nodes, edges) -> Iterator[Record]:
    for n, kind, label, line in nodes:
        yield "cfg_node", {"proc": owner, "id": str(n), "kind": kind, "label": label, "line": str(line)}
    for a, b, label in edges:
        yield "cfg_edge", {"proc": owner, "from": str(a), "to": str(b), "label": label}


def _code(text: str, name: str, known: frozenset[str]) -> Iterator[Record]:
    module, external = vba.read_module(text, name), []
    for p in module.procedures:
        effect = vba.effects(p, known)
        external += effect["external"]
        yield "procedure", {"name": p.name, "kind": p.kind, "scope": p.scope, **{k: str(v) for k, v in vba.metrics(p).items()}, "data_access": str(bool(effect["data_access"])).lower()}
        for call in effect["calls"]:
            yield "call", {"procedure": p.name, "target": call}
        for target in effect["docmd_targets"]:
            verb, _, what = target.partition(":")
            if verb in OPENERS:
                yield _reference(what, "opens", OPENERS[verb], p.name)
        for sql in effect["sql_literals"]:
            for table in source_tables(sql):
                yield _reference(table, "reads", "", p.name)
        g = vba.control_flow(p)
        yield from _graph(p.name, g.nodes, g.edges)
    for code in vba.module_findings(module, external):
        yield "finding", {"reason_code": code, "detail": name, "note": ""}


def _macro(model: macros.MacroModel, data: bool) -> Iterator[Record]:
    for h in model.handlers:
        for top in h.statements:
            for s in top.walk():
                if s.kind == "action":
                    yield "action", {"category": s.category, "action": s.name}
                for key, value in () if data else s.arguments.items():
                    if key in ARGUMENT_KINDS and value:
                        yield _reference(value, "opens", ARGUMENT_KINDS[key])
                    if key == "FunctionName" and value:
                        yield "call", {"procedure": "", "target": value.partition("(")[0].strip()}
        g = flow.statement_flow(h.event, h.statements)
        yield from _graph(h.event, g.nodes, g.edges)
    if data:
        yield _reference(model.name, "trigger", "table")
    yield from _findings(model.findings)


def _parts(kind: str, name: str, text: str, known: frozenset[str]) -> Iterator[Record]:
    """The records of one part."""
    if kind == "table":
        t = schema.read_table(text, name)
        yield "object", {"name": t.name, "columns": str(len(t.columns)), "text": t.ddl()}
        yield from _findings(t.findings)
    elif kind == "query":
        q = read_query(text, name, known)
        yield "object", {"name": name, "type": q.query_type, "text": q.sql or ""}
        yield from (_reference(d, "reads") for d in q.dependencies)
        yield from _findings(q.findings)
    elif kind in ("form", "report"):
        f = forms.read_form(text, name, kind)
        yield "object", {"name": name, "type": kind, "text": f.record_source or ""}
        yield from (_reference(d, "reads") for d in f.dependencies)
        for c in f.controls:
            for b in c.bindings:
                if b.kind == "subform":
                    hint, _, inner = b.source.rpartition(".")
                    yield _reference(inner, "embeds", hint.lower())
        for e in f.events:
            if e.handler_kind == "macro_object":
                yield _reference(e.handler, "handles", "macro")
            elif e.handler_kind == "vba_procedure":
                yield "handler", {"procedure": e.handler}
        yield from _findings(f.findings)
        if f.code:
            yield from _code(f.code, name, known)
    elif kind == "macro":
        yield "object", {"name": name, "type": "macro"}
        yield from _macro(macros.read_macro(parse_text(text), name), False)
    elif kind == "datamacro":
        yield "object", {"name": name, "type": "data_macro"}
        yield from _macro(macros.read_data_macros(text, name), True)
    elif kind == "module":
        yield "object", {"name": name, "type": "module"}
        yield from _code(text, name, known)


def _relationships(text: str | None) -> Iterator[Record]:
    for r in schema.read_relationships(text or ""):
        yield "relationship", {"name": r.name, "child": r.child, "parent": r.parent, "child_columns": json.dumps(r.child_columns), "parent_columns": json.dumps(r.parent_columns), "enforced": str(r.enforced).lower(), "cascade_update": str(r.cascade_update).lower(), "cascade_delete": str(r.cascade_delete).lower(), "ddl": r.ddl()}


def parse_part(kind: str, name: str, text: str | None, known: frozenset[str] = frozenset()) -> list[Record]:
    """Records of a part; one that fails to parse is an object with a finding."""
    if kind == "relationships":
        try:
            return list(_relationships(text))
        except (ValueError, ElementTree.ParseError) as error:
            return [("finding", {"reason_code": "RELATIONSHIP_XML_NOT_PARSED", "detail": str(error), "note": ""})]
    try:
        if text is None:
            return [("object", {"name": name}), ("finding", {"reason_code": "SOURCE_TEXT_NOT_RETAINED", "detail": name, "note": ""})]
        return list(_parts(kind, name, text, known))
    except (ValueError, ElementTree.ParseError) as error:
        return [("object", {"name": name}), ("finding", {"reason_code": "SEMANTIC_PARSE_FAILED", "detail": str(error), "note": ""})]


@dataclass
class Conversion:
    """The parsed records of packages, and views of them; `kept` are the sorts of records that are there, all if empty."""

    records: DataFrame
    kept: tuple[str, ...] = ()

    def _view(self, record: str, *fields: str, **typed: str) -> DataFrame:
        if self.kept and record not in self.kept:
            raise ValueError(f"the conversion kept no records of sort {record!r}")
        get: list[Column] = [F.col("fields")[f].alias(f) for f in fields] + [F.col("fields")[f].cast(t).alias(f) for f, t in typed.items()]
        return self.records.filter(F.col("record") == record).select("path", "object", "kind", "ordinal", *get)

    def objects(self) -> DataFrame:
        """One row per object: its text, whether nothing blocks it, and the number of findings."""
        return self._objects()

    def _objects(self, *more: Column) -> DataFrame:
        """`objects`, with `more` aggregates of an object's findings."""
        found = self.findings().groupBy("path", "object", "kind").agg(F.count(F.lit(1)).alias("findings"), F.count_if(coverage.blocking()).alias("blocking"), *more)
        rows = self._view("object", "type", "text").drop("ordinal").join(found, ["path", "object", "kind"], "left")
        return rows.withColumn("findings", F.coalesce("findings", F.lit(0))).withColumn("translated", F.coalesce(F.col("blocking"), F.lit(0)) == 0).drop("blocking")

    def findings(self) -> DataFrame:
        return self._view("finding", "reason_code", "detail", "note").withColumn("aspect", coverage.aspect_column())

    def procedures(self) -> DataFrame:
        return self._view("procedure", "name", "scope", statements="int", branches="int", loops="int", cyclomatic_complexity="int", data_access="boolean")

    def relationships(self) -> DataFrame:
        """One row per relationship of a package: its sides, their columns in order, its rules and its DDL."""
        rows = self._view("relationship", "name", "child", "parent", "child_columns", "parent_columns", "ddl", enforced="boolean", cascade_update="boolean", cascade_delete="boolean")
        listed = {c: F.from_json(c, "array<string>") for c in ("child_columns", "parent_columns")}
        return rows.withColumns(listed).drop("object", "kind", "ordinal")

    def actions(self) -> DataFrame:
        return self._view("action", "category", "action")

    def cfg_nodes(self) -> DataFrame:
        return self._view("cfg_node", "proc", "label", id="int", line="int").drop("ordinal")

    def cfg_edges(self) -> DataFrame:
        return self._view("cfg_edge", "proc", "label", **{"from": "int", "to": "int"}).drop("ordinal")

    def nodes(self) -> DataFrame:
        """(path, id, name, kind): objects and procedures."""
        of = lambda kind, name: F.concat_ws(":", kind, F.lower(name))
        objects = self._view("object", "name").select("path", of(F.col("kind"), F.col("object")).alias("id"), F.col("object").alias("name"), "kind")
        procedures = self.procedures().select("path", of(F.concat(F.lit("proc:"), F.lower("object")), F.col("name")).alias("id"), "name", F.lit("procedure").alias("kind"))
        return objects.unionByName(procedures).distinct()

    def edges(self) -> DataFrame:
        """(path, src, dst, edge) within packages: reads, embeds, handles, trigger, opens, calls, contains."""
        own = F.concat_ws(":", "kind", F.lower("object"))
        procedure = lambda name: F.concat(F.lit("proc:"), F.lower("object"), F.lit(":"), F.lower(name))
        references = self._view("reference", "target", "edge", "hint", "procedure")
        source = F.when(F.col("procedure") == "", own).otherwise(procedure(F.col("procedure")))
        wanted = references.select("path", source.alias("src"), "target", "hint", "edge").distinct()
        rank = reduce(lambda acc, kv: acc.when(F.col("__kind") == kv[1], kv[0]), enumerate(KIND_ORDER, 1), F.when(F.col("__kind") == F.col("hint"), 0)).otherwise(9)
        named = self.nodes().filter("kind <> 'procedure' and kind <> 'datamacro'").select("path", F.lower("name").alias("__name"), F.col("id").alias("dst"), F.col("kind").alias("__kind"))
        hits = wanted.withColumn("__name", F.lower("target")).join(named, ["path", "__name"])
        first = F.row_number().over(Window.partitionBy("path", "src", "target", "hint", "edge").orderBy(rank, "dst"))
        resolved = hits.withColumn("__n", first).filter("__n = 1").select("path", "src", "dst", "edge")
        procs = self.procedures().select("path", own.alias("owner"), procedure(F.col("name")).alias("dst"), F.lower("name").alias("__name"), F.lower("object").alias("__object"))
        contains = procs.select("path", F.col("owner").alias("src"), "dst", F.lit("contains").alias("edge"))
        calls = self._view("call", "procedure", "target").select("path", F.when(F.col("procedure") == "", own).otherwise(procedure(F.col("procedure"))).alias("src"), F.lower("target").alias("__name"))
        called = calls.join(procs.select("path", "__name", "dst"), ["path", "__name"]).select("path", "src", "dst", F.lit("calls").alias("edge"))
        handlers = self._view("handler", "procedure").select("path", own.alias("src"), F.lower("object").alias("__object"), F.lower("procedure").alias("__name"))
        handled = handlers.join(procs.select("path", "__object", "__name", "dst"), ["path", "__object", "__name"]).select("path", "src", "dst", F.lit("handles").alias("edge"))
        return resolved.unionByName(contains).unionByName(called).unionByName(handled).filter("src <> dst").distinct()

    def summary(self) -> DataFrame:
        """By package and kind: objects, and those that nothing blocks, with their share."""
        out = self.objects().groupBy("path", "kind").agg(F.count(F.lit(1)).alias("objects"), F.count_if("translated").alias("complete"))
        return out.withColumn("completion_percentage", coverage.percentage(F.col("complete"), F.col("objects")))

    def payload(self, source_text: bool = True) -> DataFrame:
        """(path, payload): what a viewer of one package needs, as JSON: objects with their findings (and texts),
        procedures, control flow, and the graph. A package's limits bound its row."""

        def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
            return df.select("path", F.struct(*columns).alias(name))

        problems = F.sort_array(F.collect_list(F.struct("reason_code", "aspect", "detail", "note"))).alias("problems")
        objects = self._objects(problems)
        text = F.col("text") if source_text else F.lit(None).cast("string")
        parts = (
            listed(objects.withColumn("text", text), "objects", "kind", "object", "type", "translated", "text", "problems"),
            listed(self.procedures(), "procedures", "object", "name", "scope", "statements", "cyclomatic_complexity"),
            listed(self.cfg_edges(), "flow", "object", "proc", "from", "to", "label"),
            listed(self.nodes(), "nodes", "id", "name", "kind"),
            listed(self.edges(), "edges", "src", "dst", "edge"),
        )
        # all lists are grouped at once: a shuffle of its own for each, and joins of them, cost more than what they hold
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        lists = {c: F.sort_array(F.collect_list(c)) for c in rows.columns[1:]}
        found = rows.groupBy("path").agg(*[F.when(F.size(x) > 0, x).alias(c) for c, x in lists.items()])
        return found.filter("objects is not null").select("path", documents.json_of(found.drop("path")).alias("payload"))

    def corpus_report(self, most: int = 15) -> DataFrame:
        """(measure, name, value): totals of the corpus, and the `most` frequent blocking codes by objects, ties by code.

        An object is extracted if its text was kept, complete if nothing blocks it, else partial.
        """
        kept = self.findings().filter("reason_code = 'SOURCE_TEXT_NOT_RETAINED'").select("path", "object", "kind", F.lit(True).alias("lost")).distinct()
        rows = self.objects().join(kept, ["path", "object", "kind"], "left").withColumn("extracted", F.col("lost").isNull())
        totals = rows.agg(F.count_distinct("path").alias("artifacts"), F.count(F.lit(1)).alias("objects"), F.count_if("extracted").alias("extracted"), F.count_if(F.col("extracted") & F.col("translated")).alias("complete"), F.count_if(F.col("extracted") & ~F.col("translated")).alias("partial"))
        share = lambda c: coverage.percentage(F.col(c), F.col("objects"))
        wide = totals.withColumn("extraction_percentage", share("extracted")).withColumn("semantic_percentage", share("complete"))
        measures = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in wide.columns])).alias("m")).select(F.lit("total").alias("measure"), "m.*")
        codes = self.findings().filter(coverage.blocking()).select("path", "object", "kind", "reason_code").distinct().groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))
        top = codes.orderBy(F.desc("n"), "reason_code").limit(most)
        return measures.unionByName(top.select(F.lit("blocking_code").alias("measure"), F.col("reason_code").alias("name"), F.col("n").cast("double").alias("value")))


def write_json(df: DataFrame, path: str) -> None:
    """Writes rows as JSON lines (see `documents.sorted_json`); the folder gets its files when the job commits, or none."""
    documents.sorted_json(df).write.text(path)


def convert_parts(parts: DataFrame, *kept: str) -> Conversion:
    """Parses `parts(path, object, kind, text)`. The names of a package's procedures are known to its expressions.

    The parts are read twice, for those names and for all else, so they are unpacked into a table first. Of the records
    only those of the sorts `kept` are handed over and written (all, without any).
    """
    spark = parts.sparkSession
    parts = written(parts.select("path", "object", "kind", "text"), "parts")

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, p) for path, kind, text in zip(batch["path"], batch["kind"], batch["text"], strict=True) for p in vba.procedure_names((text or "") if kind == "module" else forms.split_code(text or "")[1] or "")]
            yield pd.DataFrame(rows, columns=["path", "name"])

    coded = parts.filter(F.col("kind").isin("form", "report", "module")).mapInPandas(names, "path string, name string")
    tasks = -(-parts.count() // MOST_PARTS)
    if tasks > spark.sparkContext.defaultParallelism:  # by number: Spark makes some task more than cores, however large the parts are
        parts, coded = parts.repartition(tasks, "path"), coded.repartition(tasks, "path")
    known = coded.groupBy("path").agg(F.collect_set("name").alias("known"))
    rows = parts.join(known, "path", "left")

    def read(path: str, name: str, kind: str, text: str | None, functions) -> tuple[list[tuple], int]:
        found = parse_part(kind, name, text, frozenset() if functions is None else frozenset(functions))
        return [(path, name, kind, record, i, fields) for i, (record, fields) in enumerate(found) if not kept or record in kept], len(text or "")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = zip(batch["path"], batch["object"], batch["kind"], batch["text"], batch["known"], strict=True)
            for out in together(read(*part) for part in parts):
                yield pd.DataFrame(out, columns=["path", "object", "kind", "record", "ordinal", "fields"])

    return Conversion(written(rows.mapInPandas(work, RECORDS), "records", "record"), kept)


def convert_packages(spark: SparkSession, path: str, pattern: str = "*.accdt") -> Conversion:
    """Converts all packages under a folder."""
    return convert_parts(object_parts(read_packages(spark, path, pattern)))


def artifact_identity(samples: DataFrame) -> DataFrame:
    """The artifact of each sample of `samples(sample_id, artifact_name, is_candidate)`: its one candidate under
    original/, else its one candidate; a sample without exactly one has a null name and the number of candidates."""
    original = F.lower("artifact_name").startswith("original/")
    found = samples.filter("is_candidate").groupBy("sample_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(original).alias("n_original"), F.min(F.when(original, F.col("artifact_name"))).alias("o"), F.min("artifact_name").alias("a"))
    name = F.when(F.col("n_original") == 1, F.col("o")).when((F.col("n_original") == 0) & (F.col("candidates") == 1), F.col("a"))
    return found.select("sample_id", name.alias("artifact_name"), "candidates")
