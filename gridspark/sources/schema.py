"""Table schemas and relationships from their XML definitions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import types as T

from gridspark.functions.neutral import analyse, identifier
from gridspark.functions.registry import Finding

_XSD, _OD = "{http://www.w3.org/2001/XMLSchema}", "{urn:schemas-microsoft-com:officedata}"

#: Field type, neutral SQL type (None: no portable one), Spark type.
TYPES: dict[str, tuple[str | None, T.DataType]] = {
    "autonumber": ("INTEGER", T.IntegerType()),
    "byte": ("SMALLINT", T.ShortType()),
    "integer": ("SMALLINT", T.ShortType()),
    "longinteger": ("INTEGER", T.IntegerType()),
    "single": ("REAL", T.FloatType()),
    "double": ("DOUBLE PRECISION", T.DoubleType()),
    "currency": ("DECIMAL(19,4)", T.DecimalType(19, 4)),
    "decimal": ("DECIMAL", T.DecimalType(28, 10)),
    "datetime": ("TIMESTAMP", T.TimestampType()),
    "text": ("VARCHAR", T.StringType()),
    "memo": ("CLOB", T.StringType()),
    "yesno": ("BOOLEAN", T.BooleanType()),
    "guid": ("CHAR(36)", T.StringType()),
    "replicationid": ("CHAR(36)", T.StringType()),
    "binary": ("BINARY", T.BinaryType()),
    "oleobject": (None, T.BinaryType()),
    "attachment": (None, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("data", T.BinaryType())]))),
    "hyperlink": ("VARCHAR", T.StringType()),
    "calculated": (None, T.StringType()),
    "multivalued": (None, T.ArrayType(T.StringType())),
    "complex": (None, T.ArrayType(T.StringType())),
}
NOT_ENFORCED, CASCADE_UPDATE, CASCADE_DELETE = 0x2, 0x100, 0x1000


def safe_xml(text: str) -> ElementTree.Element:
    """The root of an XML text; document types and entities are refused."""
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("document type or entity in XML")
    return ElementTree.fromstring(text.encode() if isinstance(text, str) else text)


@dataclass
class ColumnModel:
    name: str
    jet_type: str
    sql_type: str | None
    nullable: bool = True
    autonumber: bool = False
    max_length: int | None = None
    default: str | None = None
    rule: str | None = None
    message: str | None = None
    required: bool = False
    allow_zero_length: bool = True
    row_source: str | None = None
    bound_column: int | None = None
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class IndexModel:
    name: str
    columns: list[str]
    unique: bool
    primary: bool


@dataclass
class TableModel:
    name: str
    columns: list[ColumnModel] = field(default_factory=list)
    indexes: list[IndexModel] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)

    @property
    def primary_key(self) -> list[str]:
        return next((i.columns for i in self.indexes if i.primary), [])

    def struct(self, opt_in: bool = False) -> T.StructType:
        """The Spark schema; columns without a portable type only where `opt_in`."""
        return T.StructType([T.StructField(c.name, TYPES[c.jet_type][1], c.nullable, {"jet_type": c.jet_type}) for c in self.columns if c.jet_type in TYPES and (opt_in or c.sql_type is not None)])

    def ddl(self) -> str:
        lines = []
        for c in self.columns:
            if c.sql_type is None:
                continue
            default = analyse(c.default).sql if c.default else None
            lines.append(f"{identifier(c.name)} {c.sql_type}" + (" NOT NULL" if not c.nullable else "") + (f" DEFAULT {default}" if default else ""))
        if self.primary_key:
            lines.append(f"PRIMARY KEY ({', '.join(map(identifier, self.primary_key))})")
        lines += [f"CHECK ({analyse(with_subject(c.rule, c.name)).sql})" for c in self.columns if c.rule]
        return f"CREATE TABLE {identifier(self.name)} (\n    " + ",\n    ".join(lines) + "\n);"


def with_subject(rule: str, column: str) -> str:
    """A validation rule with the column put before a comparison that has no left side."""
    return f"[{column}] {rule}" if re.match(r"\s*(<>|<=|>=|=|<|>|(?:not\s+)?(?:between|in|like)\b|is\b)", rule, re.I) else rule


def read_table(xsd: str, name: str) -> TableModel:
    """The model of a table from its XML schema."""
    root = safe_xml(xsd)
    table = TableModel(name)
    element = next((e for e in root.findall(f"{_XSD}element") if e.get("name") == name), None)
    if element is None:
        element = next((e for e in root.findall(f"{_XSD}element") if e.get("name") != "dataroot"), None)
    if element is None:
        table.findings.append(Finding("TABLE_ELEMENT_NOT_FOUND", name))
        return table
    yes = lambda e, k: e.get(k, "").lower() == "yes"
    for index in element.iter(f"{_OD}index"):
        table.indexes.append(IndexModel(index.get("index-name", ""), index.get("index-key", "").split(), yes(index, "unique"), yes(index, "primary")))
    sequence = element.find(f"{_XSD}complexType/{_XSD}sequence")
    for e in sequence if sequence is not None else ():
        jet = (e.get(f"{_OD}jetType") or "").lower()
        props = {p.get("name"): p.get("value", "") for p in e.iter(f"{_OD}fieldProperty")}
        limit = e.find(f".//{_XSD}maxLength")
        sql = TYPES.get(jet, (None, None))[0]
        if jet not in TYPES:
            table.findings.append(Finding("JET_FIELD_TYPE_NOT_MAPPED", f"{e.get('name')}: {jet}"))
        elif sql is None:
            table.findings.append(Finding("FIELD_TYPE_HAS_NO_PORTABLE_EQUIVALENT", f"{e.get('name')}: {jet}"))
        length = int(limit.get("value")) if limit is not None else None
        if sql == "VARCHAR" and length:
            sql = f"VARCHAR({length})"
        column = ColumnModel(
            e.get("name"), jet, sql, not yes(e, f"{_OD}nonNullable"), yes(e, f"{_OD}autoUnique"), length, props.get("DefaultValue") or None, props.get("ValidationRule") or None, props.get("ValidationText") or None,
            props.get("Required", "0") not in ("0", ""), props.get("AllowZeroLength", "1") != "0", props.get("RowSource") or None, int(props["BoundColumn"]) if props.get("BoundColumn", "").isdigit() else None, props,
        )
        for text in (column.default, with_subject(column.rule, column.name) if column.rule else None):
            table.findings += [f for f in (analyse(text).findings if text else ()) if f not in table.findings]
        table.columns.append(column)
    return table


@dataclass
class Relationship:
    name: str
    child: str
    parent: str
    child_columns: list[str]
    parent_columns: list[str]
    flags: int

    @property
    def enforced(self) -> bool:
        return not self.flags & NOT_ENFORCED

    @property
    def cascade_update(self) -> bool:
        return bool(self.flags & CASCADE_UPDATE)

    @property
    def cascade_delete(self) -> bool:
        return bool(self.flags & CASCADE_DELETE)

    def ddl(self) -> str:
        names = lambda xs: ", ".join(map(identifier, xs))
        return (
            f"ALTER TABLE {identifier(self.child)} ADD CONSTRAINT {identifier(self.name)} FOREIGN KEY ({names(self.child_columns)}) REFERENCES {identifier(self.parent)} ({names(self.parent_columns)})"
            + " ON UPDATE CASCADE" * self.cascade_update + " ON DELETE CASCADE" * self.cascade_delete + ";"
        )


def read_relationships(xml: str) -> list[Relationship]:
    """Relationships by (child, name); the rows of a composite key make one."""
    found: dict[tuple[str, str, str], Relationship] = {}
    for row in safe_xml(xml).iter("MSysRelationships"):
        get = lambda k, row=row: (row.findtext(k) or "").strip()
        key = (get("szRelationship"), get("szObject"), get("szReferencedObject"))
        one = found.setdefault(key, Relationship(*key, [], [], int(get("grbit") or 0)))
        one.child_columns.append(get("szColumn"))
        one.parent_columns.append(get("szReferencedColumn"))
    return sorted(found.values(), key=lambda r: (r.child, r.name))
