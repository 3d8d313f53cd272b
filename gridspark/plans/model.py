"""Saved queries as typed models, with neutral SQL and findings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from gridspark.functions.neutral import Analysis, analyse, identifier
from gridspark.functions.registry import Finding

from .textformat import Block, parse_text

#: Join flags, option bits, the one mapped operation code.
JOIN_KINDS = {"1": "INNER JOIN", "2": "LEFT OUTER JOIN", "3": "RIGHT OUTER JOIN"}
DISTINCT, TOP = 2, 16
SELECT_OPERATION = 1
_SOURCE = re.compile(r"\b(?:FROM|JOIN|INTO|UPDATE)\s+(\[[^\]]+\]|[A-Za-z_][\w$]*)", re.I)
_STRINGS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\[[^\]]*\]")


@dataclass(frozen=True)
class Source:
    name: str
    alias: str | None = None

    @property
    def key(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    on: str
    flag: str = "1"


@dataclass(frozen=True)
class Step:
    """One attachment of the join fold: `kind` is inner, left, right or cross."""

    table: str
    kind: str
    conditions: tuple[str, ...]


@dataclass(frozen=True)
class OutputColumn:
    expression: str
    alias: str | None = None


@dataclass(frozen=True)
class Ordering:
    expression: str
    descending: bool = False


@dataclass
class QueryModel:
    name: str
    query_type: str = "select"
    representation: str = "design_grid"
    sql: str | None = None
    stored_sql: str | None = None
    connect: str | None = None
    operation: int | None = None
    distinct: bool = False
    top: str | None = None
    sources: list[Source] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    columns: list[OutputColumn] = field(default_factory=list)
    where: str | None = None
    having: str | None = None
    groups: list[OutputColumn] = field(default_factory=list)
    ordering: list[Ordering] = field(default_factory=list)
    dependencies: list[str] = field(default_factory=list)
    parameters: list[str] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)

    @property
    def translated(self) -> bool:
        return self.sql is not None and not any(f.blocking for f in self.findings)

    def add(self, code: str, detail: str, note: str = "") -> None:
        finding = Finding(code, detail, note)
        if finding not in self.findings:
            self.findings.append(finding)


def paired(block: Block | None, primary: str, after: frozenset[str] = frozenset()) -> list[tuple[str, dict[str, str]]]:
    """(value, qualifiers) of each `primary` property; qualifiers stand before it, those of `after` behind."""
    out: list[tuple[str, dict[str, str]]] = []
    waiting: dict[str, str] = {}
    for p in block.properties if block else ():
        key = p.key.casefold()
        if key == primary.casefold():
            out.append((p.value, waiting))
            waiting = {}
        elif key in after and out:
            out[-1][1][key] = p.value
        else:
            waiting[key] = p.value
    return out


def stored_kind(sql: str) -> str:
    """The type of stored SQL by its leading keyword; UNION counts outside literals only."""
    bare = _STRINGS.sub("''", sql).strip()
    m = re.match(r"(?:PARAMETERS\b[^;]*;\s*)?(\w+)", bare, re.I | re.S)
    word = m[1].lower() if m else ""
    if word == "select":
        if re.search(r"\bunion\b", bare, re.I):
            return "union"
        return "make_table" if re.search(r"\binto\b", bare, re.I) else "select"
    kinds = {"insert": "insert", "update": "update", "delete": "delete", "transform": "crosstab", "create": "data_definition", "alter": "data_definition", "drop": "data_definition"}
    return kinds.get(word, "unknown")


def source_tables(sql: str) -> list[str]:
    return list(dict.fromkeys(m.strip("[]") for m in _SOURCE.findall(sql)))


def fold_joins(model: QueryModel) -> list[Step]:
    """The join graph as steps from the first table on, in the order of tables.

    A join is attached once one of its sides is there; if that is the right side, an
    outer join turns round. Further joins between tables that are there add their
    condition to the step that brought the later one. Tables left over are crossed.
    """
    keys = [s.key for s in model.sources]
    by_fold = {k.casefold(): k for k in keys}
    if not keys:
        return []
    there = [keys[0]]
    steps: dict[str, Step] = {keys[0]: Step(keys[0], "from", ())}
    waiting = []
    for join in model.joins:
        left, right = by_fold.get(join.left.casefold()), by_fold.get(join.right.casefold())
        if left is None or right is None:
            model.add("JOIN_GRAPH_NOT_RESOLVED", join.on, "a side is not among the tables")
        else:
            waiting.append((join, left, right))
    while True:
        moved = True
        while moved:
            moved = False
            for item in list(waiting):
                join, left, right = item
                if left in steps and right in steps:
                    later = max(left, right, key=there.index)
                    step = steps[later]
                    steps[later] = Step(step.table, "inner" if step.kind == "cross" else step.kind, (*step.conditions, join.on))
                elif left in steps or right in steps:
                    new = right if left in steps else left
                    kind = {"2": "left", "3": "right"}.get(join.flag, "inner")
                    if new == left:
                        kind = {"left": "right", "right": "left"}.get(kind, kind)
                    if join.flag not in JOIN_KINDS:
                        model.add("JOIN_FLAG_NOT_MAPPED", join.flag)
                    steps[new] = Step(new, kind, (join.on,))
                    there.append(new)
                else:
                    continue
                waiting.remove(item)
                moved = True
        rest = [k for k in keys if k not in steps]
        if not rest:
            return [steps[k] for k in there]
        model.add("IMPLICIT_CROSS_JOIN", rest[0])
        steps[rest[0]] = Step(rest[0], "cross", ())
        there.append(rest[0])


def _render(model: QueryModel, known: frozenset[str]) -> str:
    def text(source: str) -> str:
        a: Analysis = analyse(source, known)
        for f in a.findings:
            model.add(f.reason_code, f.detail, f.note)
        model.parameters += [p for p in a.parameters if p not in model.parameters]
        return a.sql if a.sql is not None else source

    columns = ", ".join(text(c.expression) + (f" AS {identifier(c.alias)}" if c.alias else "") for c in model.columns) or "*"
    sources = {s.key: s for s in model.sources}
    shown = lambda k: identifier(sources[k].name) + (f" AS {identifier(sources[k].alias)}" if sources[k].alias else "")
    tables = ""
    for step in fold_joins(model):
        if step.kind == "from":
            tables = shown(step.table)
        elif step.kind == "cross":
            tables += f", {shown(step.table)}"
        else:
            word = {"inner": "INNER JOIN", "left": "LEFT OUTER JOIN", "right": "RIGHT OUTER JOIN"}[step.kind]
            tables += f" {word} {shown(step.table)} ON {' AND '.join(map(text, step.conditions))}"
    if model.top:
        model.add("TOP_CLAUSE_IS_DIALECT_SPECIFIC", model.top)
    lines = [f"SELECT {'DISTINCT ' * model.distinct}{f'TOP {model.top} ' if model.top else ''}{columns}"]
    if tables:
        lines.append(f"FROM {tables}")
    if model.where:
        lines.append(f"WHERE {text(model.where)}")
    if model.groups:
        lines.append("GROUP BY " + ", ".join(text(g.expression) for g in model.groups))
    if model.having:
        lines.append(f"HAVING {text(model.having)}")
    if model.ordering:
        lines.append("ORDER BY " + ", ".join(f"{text(o.expression)} {'DESC' if o.descending else 'ASC'}" for o in model.ordering))
    return "\n".join(lines)


def read_query(definition: str | Block, name: str = "query", known_functions: frozenset[str] | set[str] = frozenset()) -> QueryModel:
    """The model of a saved query from its definition text."""
    root = parse_text(definition) if isinstance(definition, str) else definition
    known = frozenset(known_functions)
    model = QueryModel(name)
    sql = root.get("SQL")
    if sql:
        model.representation, model.stored_sql, model.connect = "stored_sql_text", sql, root.get("Connect") or None
        model.query_type = "pass_through" if model.connect else stored_kind(sql)
        model.dependencies = source_tables(sql)
        model.sql = sql
        if model.connect:
            model.add("PASS_THROUGH_QUERY_TARGETS_EXTERNAL_SERVER", model.connect)
        elif model.query_type in ("union", "crosstab", "data_definition", "unknown"):
            model.add("STORED_SQL_NOT_RE_PARSED", model.query_type)
        return model
    code = root.get("Operation") or "1"
    model.operation = int(code) if code.lstrip("-").isdigit() else None
    option = root.get("Option") or "0"
    bits = int(option) if option.isdigit() else 0
    model.distinct, model.top = bool(bits & DISTINCT), (root.get("RowCount") if bits & TOP else None)
    if bits & ~(DISTINCT | TOP):
        model.add("QUERY_OPTION_BITS_NOT_MAPPED", str(bits & ~(DISTINCT | TOP)))
    first = lambda kind: (root.blocks(kind) or [None])[0]
    model.sources = [Source(n, q.get("alias")) for n, q in paired(first("InputTables"), "Name", frozenset({"alias"}))]
    model.columns = [OutputColumn(e, q.get("alias")) for e, q in paired(first("OutputColumns"), "Expression")]
    joins: list[Join] = []
    side: dict[str, str] = {}
    for p in (first("Joins") or Block()).properties:
        key = p.key.casefold()
        if key == "flag" and joins:
            joins[-1] = Join(joins[-1].left, joins[-1].right, joins[-1].on, p.value)
        elif key == "expression":
            joins.append(Join(side.get("lefttable", ""), side.get("righttable", ""), p.value))
        else:
            side[key] = p.value
    model.joins = joins
    model.where, model.having = root.get("Where") or None, root.get("Having") or None
    model.groups = [OutputColumn(e) for e, _ in paired(first("Groups"), "Expression", frozenset({"grouplevel"}))]
    model.ordering = [Ordering(e, q.get("flag") == "1") for e, q in paired(first("OrderBy"), "Expression", frozenset({"flag"}))]
    model.dependencies = list(dict.fromkeys(s.name for s in model.sources))
    if model.operation != SELECT_OPERATION:
        model.query_type = "unknown"
        model.add("QUERY_OPERATION_CODE_NOT_MAPPED", str(code))
        model.add("NON_SELECT_QUERY_SQL_NOT_GENERATED", str(code))
        return model
    model.sql = _render(model, known)
    return model
