"""Sequences of action queries and table definitions over tables that change.

A catalog lays snapshots of changed tables over base tables that stay as they are. A script's
steps see each other's tables; a numbered manifest that names all current snapshots is put in
place by one rename at its end, so others see all of its changes or none. A step that fails
leaves the manifest, and the script's snapshots are deleted.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .clauses import bare, fail, split_commas, without_parameters, words
from .model import QueryModel, stored_kind
from .stored import run_stored
from .tables import Tables, bracketed

#: Types of the dialect's table definitions.
TYPES = {
    "text": "string", "varchar": "string", "char": "string", "string": "string", "memo": "string", "longtext": "string", "guid": "string", "integer": "int", "long": "int", "int": "int", "counter": "int",
    "autoincrement": "int", "short": "smallint", "smallint": "smallint", "byte": "smallint", "bigint": "bigint", "double": "double", "float": "double", "number": "double", "single": "float", "real": "float",
    "currency": "decimal(19,4)", "money": "decimal(19,4)", "datetime": "timestamp", "date": "timestamp", "time": "timestamp", "bit": "boolean", "yesno": "boolean", "logical": "boolean", "boolean": "boolean", "binary": "binary",
}
_NAME = r"(\[[^\]]+\]|[^\W\d]\w*)"


def column_type(text: str) -> str:
    """The Spark type of a column's type; DECIMAL keeps its precision, other lengths are not kept."""
    m = re.match(r"(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", text.strip())
    name = m[1].lower() if m else ""
    if name in ("decimal", "numeric", "dec"):
        return f"decimal({m[2] or 18},{m[3] or 0})"
    if name not in TYPES:
        raise fail(f"type {text.strip()}")
    return TYPES[name]


class Catalog:
    """Tables by name (in any case): the snapshots of a folder over base tables.

    `folder` is shared by all executors. Manifests there are never changed; the one of the
    highest number counts, so readers of an earlier one keep their tables.
    """

    def __init__(self, spark: SparkSession, base: Tables, folder: str):
        self.spark, self.base, self.folder = spark, base, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _manifest(self) -> tuple[int, dict[str, str | None]]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        numbers = [int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)", n))]
        if not numbers:
            return 0, {}
        number = max(numbers)
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifest-{number}").collect()  # a name and a path a table
        return number, json.loads(rows[0].value)

    def _reader(self, now: dict[str, str | None]) -> Tables:
        def read(name: str) -> DataFrame:
            key = name.casefold()
            if key not in now:
                return self.base(name)
            if now[key] is None:
                raise fail(f"no table {name}")
            return self.spark.read.parquet(now[key])

        return read

    def __call__(self, name: str) -> DataFrame:
        return self._reader(self._manifest()[1])(name)

    def run(self, script: Iterable[str], params: dict[str, object] | None = None) -> DataFrame | None:
        """Runs statements in turn and puts their tables in place together; the rows of the last one, if it is a SELECT."""
        number, before = self._manifest()
        now, made, last = dict(before), [], None
        try:
            for sql in script:
                last = self._step(without_parameters(sql), sql, now, made, params)
        except Exception:
            for path in made:
                self._fs.delete(self._path(path), True)
            raise
        if now != before:
            self._commit(number + 1, now, made)
        return last

    def _commit(self, number: int, now: dict[str, str | None], made: list[str]) -> None:
        target, draft = f"{self.folder}/manifest-{number}", f"{self.folder}/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(draft), self._path(target)):
            for path in (draft, *made):
                self._fs.delete(self._path(path), True)
            raise RuntimeError("another script changed the tables meanwhile")

    def _keep(self, name: str, df: DataFrame, now: dict[str, str | None], made: list[str]) -> None:
        path = f"{self.folder}/{re.sub(r'\W', '_', name.casefold())}-{uuid.uuid4().hex}"
        made.append(path)
        df.write.parquet(path)
        now[name.casefold()] = path

    def _exists(self, name: str, now: dict[str, str | None]) -> bool:
        if name.casefold() in now:
            return now[name.casefold()] is not None
        try:
            self.base(name)
        except Exception:  # any reader's way to say that there is none
            return False
        return True

    def _step(self, sql: str, whole: str, now: dict[str, str | None], made: list[str], params: dict[str, object] | None) -> DataFrame | None:
        kind, tables = stored_kind(sql), self._reader(dict(now))
        if kind == "data_definition":
            self._define(sql, now, made)
            return None
        rows = run_stored(QueryModel("step", stored_sql=whole), tables, params)
        if kind in ("select", "union", "crosstab"):
            return rows
        target = self._target(kind, sql)
        if kind == "make_table" and self._exists(target, now):
            raise fail(f"{target} is there already")
        self._keep(target, rows, now, made)
        return None

    @staticmethod
    def _target(kind: str, sql: str) -> str:
        """The table that an action query changes or makes."""
        if kind == "delete":
            named = re.match(rf"DELETE\s+{_NAME}\s*\.\s*\*", sql, re.I)
            key = bare(named[1]) if named else None
        found = words(sql)
        at = {"insert": "into", "make_table": "into", "delete": "from", "update": "update"}[kind]
        begin = next(b for w, _, b in found if w == at)
        if kind in ("insert", "make_table"):
            return bare(re.match(rf"\s*{_NAME}", sql[begin:])[1])
        from .clauses import read_from

        end = next((a for w, a, _ in found if a > begin and w in ("set", "where")), len(sql))
        model = QueryModel(kind)
        read_from(sql[begin:end], model, {})
        if kind == "delete" and key:
            return next(s.name for s in model.sources if s.key.casefold() == key.casefold())
        return model.sources[0].name

    def _define(self, sql: str, now: dict[str, str | None], made: list[str]) -> None:
        """CREATE TABLE, ALTER TABLE ADD or DROP COLUMN, DROP TABLE; indexes and constraints are no part of a snapshot."""
        create = re.match(rf"CREATE\s+TABLE\s+{_NAME}\s*\((.*)\)\s*$", sql, re.I | re.S)
        alter = re.match(rf"ALTER\s+TABLE\s+{_NAME}\s+(ADD|DROP)\s+(?:COLUMN\s+)?(?!CONSTRAINT\b){_NAME}\s*(.*)$", sql, re.I | re.S)
        drop = re.match(rf"DROP\s+TABLE\s+{_NAME}\s*$", sql, re.I)
        name = bare((create or alter or drop)[1]) if create or alter or drop else ""
        if create:
            if self._exists(name, now):
                raise fail(f"{name} is there already")
            columns = [re.match(rf"{_NAME}\s+(.*)$", c, re.S) for c in split_commas(create[2]) if not re.match(r"(CONSTRAINT|PRIMARY|UNIQUE|FOREIGN)\b", c, re.I)]
            if not columns or None in columns:
                raise fail(f"columns of {name}")
            schema = ", ".join(f"{bracketed(bare(m[1]))} {column_type(m[2])}" for m in columns)
            self._keep(name, self.spark.createDataFrame([], StructType.fromDDL(schema)), now, made)
        elif alter and self._exists(name, now):
            df, column = self._reader(now)(name), bare(alter[3])
            have = {c.lower(): c for c in df.columns}
            if (column.lower() in have) == (alter[2].lower() == "add"):
                raise fail(f"column {column} of {name}")
            changed = df.selectExpr("*", f"cast(null as {column_type(alter[4])}) as {bracketed(column)}") if alter[2].lower() == "add" else df.drop(have[column.lower()])
            self._keep(name, changed, now, made)
        elif drop and self._exists(name, now):
            now[name.casefold()] = None
        else:
            raise fail(sql[:60])
