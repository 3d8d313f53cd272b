"""Object inventories of a corpus: one JSON file a sample, as tables of units and faults.

A file lists the databases of a sample, each with declared counts and named objects, or
it is the list of one template package, by kind. Files are read side by side into flat
units; counts are reconciled with names by joins. `Inventory.checked` raises where
the corpus is at fault; nothing of a faulty corpus is passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.checkpoints import written

from .convert import artifact_identity

#: Count keys, lower-cased and without white space; beginnings of further ones;
#: the lists of a template package; words of format descriptions, the first that occurs counts.
COUNT_KEYS = {"table": "table", "table(linked)": "table_linked", "linkedtable": "table_linked", "table(odbc-linked)": "table_odbc", "table(odbclinked)": "table_odbc", "query": "query", "form": "form", "report": "report", "macro": "macro", "module": "module"}
KEY_BEGINNINGS = {"hiddenquery": "query_hidden", "datamacro": "macro_data"}
PACKAGE_LISTS = {"tables": "table", "queries": "query", "forms": "form", "reports": "report", "macros": "macro", "data_macros": "macro_data", "modules": "module"}
FORMATS = {"accdt": "accdt", "jet3": "jet3", "jet 3": "jet3", "jet4": "jet4", "jet 4": "jet4", "ace": "ace"}

UNITS = "source string, sample string, artifact string, format_family string, record string, bucket string, name string, ordinal long, n long"
_NAMES = [c.split()[0] for c in UNITS.split(", ")]
KEYS = ["source", "sample", "artifact", "format_family", "bucket"]


class InventoryError(ValueError):
    """A corpus whose inventories are malformed, ambiguous or inconsistent."""


def bucket_of(key: object) -> str | None:
    """The bucket of a count key or object kind, whatever its case and spacing; None for an unknown one."""
    bare = "".join(key.lower().split()) if isinstance(key, str) else ""
    return COUNT_KEYS.get(bare) or next((b for begin, b in KEY_BEGINNINGS.items() if bare.startswith(begin)), None)


def bucket_column(key: str = "key") -> Column:
    """`bucket_of` as a column."""
    return _bucket(F.col(key))


def _bucket(key: Column) -> Column:
    bare = F.regexp_replace(F.lower(key), r"\s", "")
    table = F.create_map(*[F.lit(x) for kv in COUNT_KEYS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, bare), *[F.when(bare.startswith(begin), b) for begin, b in KEY_BEGINNINGS.items()])


def _get(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


#: Types that only objects and lists can be read as; telling their whole schema would go through all that they hold.
_READ_AS = {"OBJECT": "map<string,variant>", "ARRAY": "array<variant>"}


def _is(value: Column, kind: str) -> Column:
    if kind in _READ_AS:
        return F.try_variant_get(value, "$", _READ_AS[kind]).isNotNull()
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _as_text(value: Column) -> Column:
    """A value that is a text, and not an empty one; else null."""
    return F.when(_is(value, "STRING"), F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def _fault(*tests: tuple[Column, Column]) -> Column:
    """The text of the first test that fails."""
    return F.coalesce(*[F.when(bad, text) for bad, text in tests])


def _first(faults: Column) -> Column:
    return F.get(F.filter(faults, lambda f: f.isNotNull()), 0)


def _unit(record: str, artifact: Column | None = None, family: Column | None = None, bucket: Column | None = None, name: Column | None = None, ordinal: Column | None = None, n: Column | None = None) -> Column:
    cast = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(cast(artifact, "string").alias("artifact"), cast(family, "string").alias("format_family"), F.lit(record).alias("record"), cast(bucket, "string").alias("bucket"), cast(name, "string").alias("name"), cast(ordinal, "long").alias("ordinal"), cast(n, "long").alias("n"))


def _family(description: Column) -> Column:
    return F.coalesce(*[F.when(description.contains(word), family) for word, family in FORMATS.items()])


def _counts_fault(counts: Column) -> Column:
    """What is wrong with declared counts; keys are looked at in their order by name."""
    entries = F.map_entries(F.try_variant_get(counts, "$", "map<string,variant>"))
    one = lambda e: _fault(
        (_bucket(e["key"]).isNull(), F.concat(F.lit("count key "), _quoted(e["key"]), F.lit(" is unknown"))),
        (~_is(e["value"], "BIGINT") | (F.try_variant_get(e["value"], "$", "bigint") < 0), F.concat(F.lit("the count of "), _quoted(e["key"]), F.lit(" is no non-negative integer"))),
    )
    return F.coalesce(F.when(~_is(counts, "OBJECT"), "counts is not an object"), _first(F.transform(entries, one)))


def _declared(counts: Column, artifact: Column | None, family: Column) -> Column:
    entries = F.map_entries(F.try_variant_get(counts, "$", "map<string,variant>"))
    return F.transform(entries, lambda e: _unit("declared", artifact, family, _bucket(e["key"]), n=F.try_variant_get(e["value"], "$", "bigint")))


def _database_fault(d: Column) -> Column:
    file, description = _as_text(_get(d, "file")), F.lower(_as_text(_get(d, "format")))
    objects = _get(d, "objects", "array<variant>")
    one = lambda o, i: _fault(
        (~_is(o, "OBJECT") | F.coalesce(_bucket(_as_text(_get(o, "kind"))), F.lit("")).eqNullSafe(""), F.concat(F.lit("object "), i.cast("string"), F.lit(" of "), _quoted(file), F.lit(" has no known kind"))),
        (_as_text(_get(o, "name")).isNull(), F.concat(F.lit("name of object "), i.cast("string"), F.lit(" of "), _quoted(file), F.lit(" is not a text"))),
    )
    return F.coalesce(
        _fault(
            (~_is(d, "OBJECT"), F.lit("an entry of databases is not an object")),
            (file.isNull(), F.lit("file is not a text")),
            (description.isNull(), F.concat(F.lit("format of "), _quoted(file), F.lit(" is not a text"))),
            (_family(description).isNull(), F.concat(F.lit("format "), _quoted(description), F.lit(" is unknown"))),
        ),
        _counts_fault(_get(d, "counts")),
        F.when(~_is(_get(d, "objects"), "ARRAY"), F.concat(F.lit("objects of "), _quoted(file), F.lit(" is not a list"))),
        _first(F.transform(objects, one)),
    )


def _database_units(d: Column) -> Column:
    file = _as_text(_get(d, "file"))
    family = _family(F.lower(_as_text(_get(d, "format"))))
    named = F.transform(_get(d, "objects", "array<variant>"), lambda o, i: _unit("object", file, family, _bucket(_as_text(_get(o, "kind"))), _as_text(_get(o, "name")), i, F.lit(1)))
    return F.concat(F.array(_unit("artifact", file, family)), _declared(_get(d, "counts"), file, family), named)


def _package_fault(v: Column) -> Column:
    tests = []
    for key in PACKAGE_LISTS:
        entries = F.transform(_get(v, key, "array<variant>"), lambda x: F.when(_as_text(x).isNull(), f"an entry of {key} is not a text"))  # noqa: B023
        tests += [F.when(~_is(_get(v, key), "ARRAY"), f"{key} is not a list"), _first(entries)]
    return F.coalesce(_counts_fault(_get(v, "counts")), *tests)


def _package_units(v: Column) -> Column:
    """The units of a template package, whose name is found among the sample's files later."""
    family, before, lists = F.lit("accdt"), F.lit(0), []
    for key, bucket in PACKAGE_LISTS.items():
        entries = _get(v, key, "array<variant>")
        lists.append(F.transform(entries, lambda x, i: _unit("object", None, family, F.lit(bucket), _as_text(x), before + i, F.lit(1))))  # noqa: B023
        before = before + F.size(entries)
    return F.concat(F.array(_unit("artifact", None, family)), _declared(_get(v, "counts"), None, family), *lists)


@dataclass
class Inventory:
    """The units of a corpus; its views are DataFrames."""

    units: DataFrame

    def artifacts(self) -> DataFrame:
        return self.units.filter("record = 'artifact'").select("source", "sample", "artifact", "format_family")

    def objects(self) -> DataFrame:
        """Named objects with their bucket, each of weight 1, in the order of their lists."""
        return self.units.filter("record = 'object'").select(*KEYS, "name", "ordinal", F.col("n").alias("weight"))

    def counts(self) -> DataFrame:
        """By artifact and bucket: declared, named and residual."""
        of = lambda record: F.coalesce(F.sum(F.when(F.col("record") == record, F.col("n"))), F.lit(0))
        rows = self.units.filter("record in ('declared', 'object')").groupBy(*KEYS).agg(of("declared").alias("declared"), of("object").alias("named"))
        return rows.withColumn("residual", F.col("declared") - F.col("named"))

    def count_only(self) -> DataFrame:
        """Units without a name: what the declared counts of a database exceed its named objects by, as weight."""
        return self.counts().filter("residual > 0 and format_family <> 'accdt'").select(*KEYS, F.col("residual").alias("weight"))

    def faults(self) -> DataFrame:
        """(source, fault): unreadable files, samples of one name, packages without one file, counts that names belie."""
        read = self.units.filter("record = 'fault'").select("source", F.col("name").alias("fault"))
        twice = self.units.filter("sample is not null").select("source", "sample").distinct().groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.max("source").alias("source"))
        same = twice.filter("n > 1").select("source", F.concat(F.lit("the sample "), "sample", F.lit(" is there twice")).alias("fault"))
        lost = self.artifacts().filter("artifact is null").select("source", F.lit("its package is missing or ambiguous").alias("fault"))
        wrong = self.counts().filter("residual < 0 or (format_family = 'accdt' and residual <> 0)")
        counts = wrong.select("source", F.format_string("%s of %s: %d declared, %d named", "bucket", F.coalesce("artifact", F.lit("the package")), "declared", "named").alias("fault"))
        return read.unionByName(same).unionByName(lost).unionByName(counts)

    def checked(self) -> Inventory:
        """This inventory; InventoryError if anything is at fault or there is no file."""
        found = self.faults().orderBy("source", "fault").limit(5).collect()
        if found:
            raise InventoryError("; ".join(f"{r.source}: {r.fault}" for r in found))
        if self.units.isEmpty():
            raise InventoryError("no inventory")
        return self


def read_units(files: DataFrame) -> Inventory:
    """The units of `files(source, content)`: texts of inventory files.

    A file is one VARIANT value, which is tested in its order (keys of an object by name); the
    first thing wrong is its fault, and it gives no other unit. The units are written once, as every view reads them.
    """
    value = files.select("source", F.try_parse_json("content").alias("v"))
    v = F.col("v")
    databases = _get(v, "databases", "array<variant>")
    listed = _is(_get(v, "databases"), "ARRAY")
    packed = F.lit(True)
    for key in ("counts", *PACKAGE_LISTS):
        packed = packed & _get(v, key).isNotNull()
    names = F.transform(databases, lambda d: _as_text(_get(d, "file")))
    fault = F.coalesce(
        _fault((v.isNull(), F.lit("the file is no JSON")), (~_is(v, "OBJECT"), F.lit("the file is not an object")), (_as_text(_get(v, "sample")).isNull(), F.lit("sample is not a text"))),
        F.when(listed, _first(F.transform(databases, _database_fault))),
        F.when(listed & (F.size(F.array_distinct(names)) < F.size(names)), "an artifact is there twice"),
        F.when(~listed & packed, _package_fault(v)),
        F.when(~listed & ~packed, "the file has an unknown shape"),
    )
    units = F.when(F.col("fault").isNotNull(), F.array(_unit("fault", name=F.col("fault")))).when(listed, F.flatten(F.transform(databases, _database_units))).otherwise(_package_units(v))
    rows = value.withColumn("fault", fault).select("source", F.when(F.col("fault").isNull(), _as_text(_get(v, "sample"))).alias("sample"), F.explode_outer(units).alias("u"))
    # outer, as for a plain explode Spark asks for the length of the list first and so makes it twice
    listing = rows.filter("u is not null").select("source", "sample", *[f"u.{c}" for c in _NAMES[2:]])
    return Inventory(written(listing, "units"))


def read_inventories(spark: SparkSession, path: str) -> Inventory:
    """The inventories `*/object_inventory.json` under a folder, with the names of template packages.

    A package is the one .accdt file under the sample's original/ folder, else its one .accdt file.
    """
    source = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/object_inventory\.json)$", 1)
    texts = spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/*/object_inventory.json").select(source.alias("source"), F.col("value").alias("content"))
    units = read_units(texts).units
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = F.regexp_replace(F.col("path"), r"/object_inventory\.json$", "/")
    roots = listing.filter(F.col("path").endswith("/object_inventory.json")).select(root.alias("root"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sample_id"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")))
    packages = listing.filter(F.lower("path").endswith(".accdt")).select("path", F.explode(above).alias("root"))
    inside = packages.join(roots, "root").select("sample_id", F.substring(F.col("path"), F.char_length("root") + 1, F.char_length("path")).alias("artifact_name"), F.lit(True).alias("is_candidate"))
    named = artifact_identity(inside).select(F.concat("sample_id", F.lit("/object_inventory.json")).alias("source"), F.col("artifact_name").alias("package"))
    known = units.join(named, "source", "left")
    artifact = F.coalesce("artifact", F.when(F.col("format_family") == "accdt", F.regexp_extract("package", r"([^/]+)$", 1)))
    return Inventory(known.withColumn("artifact", artifact).select(*_NAMES))
