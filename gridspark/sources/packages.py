"""Package files (ZIP) and their parts, read as DataFrames."""

from __future__ import annotations

import hashlib
import io
import re
import stat
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.neutral import analyse

from . import catalogs

#: Limits of a package, and which parts define objects.
MOST_ENTRIES, ENTRY_BYTES, TOTAL_BYTES, MOST_RATIO, RATIO_FROM = 5000, 16 << 20, 128 << 20, 250, 1 << 20
PARTS = r"^template/database/objects/(?i:(table)([^/]+)\.xsd|(query|form|report|macro|module)([^/]+)\.txt|datamacros/(datamacro)s([^/]+)\.axl)$"
RELATIONSHIPS = "template/database/relationships.xml"
TEMPLATE = "template/template.xml"
DATABASES = (".mdb", ".accdb")
#: Rows and bytes of the frames that tasks hand over.
BATCH_ROWS, BATCH_BYTES = 5000, 8 << 20
ENTRIES = "path string, name string, size long, sha256 string, encoding string, text string, diagnostic string"


def entry_problem(info: zipfile.ZipInfo, seen: set[str]) -> str | None:
    """Why an entry of a package is unsafe, or None."""
    name = info.filename.replace("\\", "/")
    if name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"):
        return "UNSAFE_PACKAGE_PATH"
    if name.casefold() in seen:
        return "DUPLICATE_PACKAGE_ENTRY"
    if info.flag_bits & 1:
        return "ENCRYPTED_PACKAGE_ENTRY"
    if stat.S_ISLNK(info.external_attr >> 16):
        return "UNSAFE_PACKAGE_ENTRY_TYPE"
    if info.file_size > ENTRY_BYTES:
        return "PACKAGE_LIMIT_EXCEEDED"
    if info.file_size > RATIO_FROM and info.file_size > MOST_RATIO * max(info.compress_size, 1):
        return "PACKAGE_LIMIT_EXCEEDED"
    return None


def decode(payload: bytes) -> tuple[str | None, str | None]:
    """(encoding, text): UTF-16 with a mark, UTF-8 with or without one; None for other bytes."""
    kinds = ["utf-16"] if payload[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-8-sig"]
    for kind in kinds:
        try:
            return kind, payload.decode(kind)
        except UnicodeDecodeError:
            continue
    return None, None


def read_entries(path: str, content: bytes) -> list[tuple]:
    """Rows of ENTRIES of one package, by name; a package that breaks a limit is one row with a diagnostic."""
    bad = lambda code: [(path, None, None, None, None, None, code)]
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        infos = sorted((i for i in package.infolist() if not i.is_dir()), key=lambda i: i.filename)
    except zipfile.BadZipFile:
        return bad("INVALID_ACCDT_PACKAGE")
    if len(infos) > MOST_ENTRIES:
        return bad("PACKAGE_LIMIT_EXCEEDED")
    if sum(i.file_size for i in infos) > TOTAL_BYTES:
        return bad("PACKAGE_LIMIT_EXCEEDED")
    out, seen = [], set()
    for info in infos:
        problem = entry_problem(info, seen)
        if problem:
            return bad(problem)
        seen.add(info.filename.replace("\\", "/").casefold())
        payload = package.read(info)
        encoding, text = decode(payload) if re.search(r"\.(xsd|txt|axl|xml)$", info.filename, re.I) else (None, None)
        out.append((path, info.filename, len(payload), hashlib.sha256(payload).hexdigest(), encoding, text, None))
    if TEMPLATE not in {i.filename.casefold() for i in infos}:
        return bad("INVALID_ACCDT_PACKAGE")
    return out


def together(found: Iterable[tuple[list[tuple], int]]) -> Iterator[list[tuple]]:
    """Rows of several files (rows, bytes) in one list, as far as BATCH_ROWS and BATCH_BYTES go: a frame of a few rows costs more than reading them."""
    out, held = [], 0
    for rows, size in found:
        if out and (len(out) + len(rows) > BATCH_ROWS or held + size > BATCH_BYTES):
            yield out
            out, held = [], 0
        out += rows
        held += size
    if out:
        yield out


def package_entries(files: DataFrame) -> DataFrame:
    """Entries of the packages in `files(path, content)`, as read by the binaryFile source; see ENTRIES."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def read(path: str, content: bytes) -> tuple[list[tuple], int]:
        rows = read_entries(path, bytes(content))
        return rows, sum(r[2] or 0 for r in rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in together(read(*file) for file in zip(batch["path"], batch["content"], strict=True)):
                yield pd.DataFrame(rows, columns=names).astype({"size": "Int64"})

    return files.select("path", "content").mapInPandas(work, ENTRIES)


def _part(*groups: int, name: Column | str = "name") -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(name, PARTS, i), F.lit("")) for i in groups])


def object_kind(name: Column | str = "name") -> Column:
    """The kind of object that an entry defines by its name; null for other entries."""
    return F.lower(_part(1, 3, 5, name=name))


def object_parts(entries: DataFrame) -> DataFrame:
    """Entries that define an object, with its kind and its name as definitions call it; and the relationships."""
    relationships = F.col("name") == RELATIONSHIPS
    rows = entries.withColumn("kind", F.when(relationships, "relationships").otherwise(object_kind())).filter("kind is not null")
    return rows.withColumn("object", F.when(relationships, "relationships").otherwise(_part(2, 4, 6)))


#: What entries that define no object are about: feature, pattern of the path, reason code.
FEATURES = (
    ("table_data", "/sampledata/", "TABLE_DATA_TRANSLATION_NOT_IMPLEMENTED"),
    ("object_properties", "/properties/", "OBJECT_PROPERTIES_NORMALIZATION_NOT_IMPLEMENTED"),
    ("relationships", f"^{RELATIONSHIPS}$", "RELATIONSHIP_TRANSLATION_NOT_IMPLEMENTED"),
    ("navigation_pane", "^template/database/navpane.xml$", "NAVIGATION_METADATA_TRANSLATION_NOT_IMPLEMENTED"),
    ("database_properties", "^template/database/databaseproperties.xml$", "DATABASE_PROPERTIES_TRANSLATION_NOT_IMPLEMENTED"),
    ("vba_references", "^template/database/vbareferences.xml$", "VBA_REFERENCE_TRANSLATION_NOT_IMPLEMENTED"),
    ("embedded_resources", "/resources/", "EMBEDDED_RESOURCE_TRANSLATION_NOT_IMPLEMENTED"),
    ("package_relationships", "/_rels/|[.]rels$", "PACKAGE_RELATIONSHIP_NORMALIZATION_NOT_IMPLEMENTED"),
    ("package_metadata", "", "PACKAGE_METADATA_NORMALIZATION_NOT_IMPLEMENTED"),
)
TARGET = ("target_generation", "TARGET_GENERATOR_NOT_IMPLEMENTED")


def features(entries: DataFrame) -> DataFrame:
    """(path, feature, status, reason_code, entries, names, objects) of what a package holds beside objects.

    The first pattern that an entry's path has is its feature; each package has
    a row of what is made of its `objects`, too.
    """
    rows = entries.filter("name is not null").withColumn("part", object_kind())
    low = F.lower("name")
    which = F.coalesce(*[F.when(low.rlike(pattern), F.lit(i)) for i, (_, pattern, _) in enumerate(FEATURES)])
    other = F.when(F.col("part").isNull(), F.struct(which.alias("which"), "name"))
    found = rows.groupBy("path").agg(F.count("part").alias("objects"), F.sort_array(F.collect_list(other)).alias("others"))

    def row(feature: str, code: str, names: Column, objects: Column) -> Column:
        size = F.size(names).cast("long")
        return F.struct(F.lit(feature).alias("feature"), F.lit("not_started").alias("status"), F.lit(code).alias("reason_code"), size.alias("entries"), names.alias("names"), objects.alias("objects"))

    names = lambda i: F.transform(F.filter("others", lambda o: o["which"] == i), lambda o: o["name"])
    made = [row(feature, code, names(i), F.lit(None).cast("long")) for i, (feature, _, code) in enumerate(FEATURES)]
    target = row(*TARGET, F.array().cast("array<string>"), F.col("objects"))
    return found.select("path", F.explode(F.array(*made, target)).alias("f")).select("path", "f.*").filter((F.col("entries") > 0) | F.col("objects").isNotNull())


def read_packages(spark: SparkSession, path: str, pattern: str = "*.accdt") -> DataFrame:
    return package_entries(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def system_object(name: Column, kind: Column) -> Column:
    """Whether a row of a catalog is none of the user's objects."""
    return name.startswith("MSys") | name.startswith("f_") | name.startswith("~TMPCLP") | F.coalesce(kind, F.lit("infrastructure")).isin("infrastructure", "container", "relationship")


def catalog_objects(files: DataFrame) -> DataFrame:
    """(path, format, name, type_code, kind, diagnostic, hidden) of the objects of the binary databases in
    `files(path, content)`, without system objects; a database that cannot be read is one row with a diagnostic."""

    def read(at: str, content: bytes) -> tuple[list[tuple], int]:
        try:
            kind, rows = catalogs.read_catalog(bytes(content))
        except catalogs.CatalogError as error:
            return [(at, None, None, None, None, str(error))], 0
        return [(at, kind, r.name, r.type_code, r.kind, None) for r in rows], sum(len(r.name) for r in rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for out in together(read(*file) for file in zip(batch["path"], batch["content"], strict=True)):
                yield pd.DataFrame(out, columns=["path", "format", "name", "type_code", "kind", "diagnostic"]).astype({"type_code": "Int64"})

    rows = files.select("path", "content").mapInPandas(work, "path string, format string, name string, type_code int, kind string, diagnostic string")
    name = F.col("name")
    return rows.filter(F.col("diagnostic").isNotNull() | ~system_object(name, F.col("kind"))).withColumn("hidden", name.startswith("~"))


def read_catalogs(spark: SparkSession, path: str, pattern: str = "*.{mdb,accdb}") -> DataFrame:
    """`catalog_objects` of the binary databases under a folder."""
    return catalog_objects(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def input_status(files: DataFrame, in_memory: bool = False) -> DataFrame:
    """(path, family, status, reason_code, objects): what becomes of each of `files(path, content)`, by its suffix.

    Packages are converted; of binary databases only the catalog is read, and none where
    the input has no file (`in_memory`); other files are refused. Each file is read once, in one row.
    """

    def read(path: str, suffix: str, content: bytes) -> tuple[list[tuple], int]:
        names, kinds, family, fault = [], [], None, None
        if suffix == ".accdt":
            rows = read_entries(path, bytes(content))
            names, fault = [r[1] for r in rows if r[1] is not None], rows[0][6]
            kinds = [None] * len(names)
        elif suffix in DATABASES and not in_memory:
            try:
                family, rows = catalogs.read_catalog(bytes(content))
                names, kinds = [r.name for r in rows], [r.kind for r in rows]
            except catalogs.CatalogError as error:
                fault = str(error)
        return [(path, suffix, names, kinds, family, fault)], sum(map(len, names))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for out in together(read(*file) for file in zip(batch["path"], batch["suffix"], batch["content"], strict=True)):
                yield pd.DataFrame(out, columns=["path", "suffix", "names", "kinds", "family", "fault"])

    typed = files.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content").filter("suffix is not null")
    rows = typed.mapInPandas(work, "path string, suffix string, names array<string>, kinds array<string>, family string, fault string")
    package, binary, bad = F.col("suffix") == ".accdt", F.col("suffix").isin(*DATABASES), F.col("fault").isNotNull()
    parts = F.size(F.filter("names", lambda n: object_kind(n).isNotNull())).cast("long")
    found = F.size(F.filter(F.arrays_zip("names", "kinds"), lambda o: ~system_object(o["names"], o["kinds"]))).cast("long")
    packed = F.coalesce("fault", F.when(parts == 0, "NO_ACCESS_OBJECT_DEFINITIONS"))
    database = F.when(bad, "BINARY_CATALOG_NOT_READABLE").otherwise("BINARY_OBJECT_DEFINITION_EXTRACTION_NOT_IMPLEMENTED")
    databases = ("jet_or_ace_binary", "unsupported", "BINARY_INPUT_REQUIRES_A_FILE_PATH", F.lit(0)) if in_memory else (F.col("family"), F.when(bad, "unsupported").otherwise("discovered"), database, found)
    of = lambda a, b, c: F.when(package, a).when(binary, b).otherwise(c)
    return rows.select(
        "path",
        of("accdt", databases[0], None).alias("family"),
        of(F.when(packed.isNull(), "converted").otherwise("failed"), databases[1], "unsupported").alias("status"),
        of(packed, databases[2], "UNSUPPORTED_INPUT_FORMAT").alias("reason_code"),
        of(parts, databases[3], 0).cast("long").alias("objects"),
    )


def expression_rows(sources: DataFrame, column: str = "source") -> DataFrame:
    """Analysis of a column of expressions: parsed, sql, translatable, identifiers, functions, codes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [analyse(x) for x in batch[column]]
            yield batch.assign(parsed=[a.parsed for a in found], sql=[a.sql for a in found], translatable=[a.translatable for a in found], identifiers=[a.identifiers for a in found], functions=[a.functions for a in found], codes=[[f.reason_code for f in a.findings] for a in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields)
    return sources.mapInPandas(work, f"{schema}, parsed boolean, sql string, translatable boolean, identifiers array<string>, functions array<string>, codes array<string>")
