"""Expressions as target-neutral SQL text, with findings for what has no such form.

The text is for reading and comparing; queries are compiled from the tree, never
from this text.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from .grammar import SUBQUERIES, Node, ParseError, parse, walk
from .registry import DIRECT, HOST_ROOTS, UI_ROOTS, Finding, support_of

_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_CASTS = {
    "cint": "INTEGER", "clng": "INTEGER", "cbyte": "INTEGER", "cdbl": "DOUBLE PRECISION", "csng": "DOUBLE PRECISION", "val": "DOUBLE PRECISION",
    "ccur": "DECIMAL(19,4)", "cdec": "DECIMAL(19,4)", "cstr": "VARCHAR", "str": "VARCHAR", "cdate": "TIMESTAMP", "cbool": "BOOLEAN",
}


def identifier(name: str) -> str:
    return name if _BARE.fullmatch(name) else '"' + name.replace('"', '""') + '"'


@dataclass
class Analysis:
    """What is known about one expression."""

    source: str
    tree: Node | None = None
    sql: str | None = None
    identifiers: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)
    ui_references: list[str] = field(default_factory=list)
    parameters: list[str] = field(default_factory=list)
    parse_error: str | None = None

    @property
    def parsed(self) -> bool:
        return self.parse_error is None

    @property
    def translatable(self) -> bool:
        return self.parsed and not any(f.blocking for f in self.findings)

    def add(self, code: str, detail: str, note: str = "") -> None:
        finding = Finding(code, detail, note)
        if finding not in self.findings:
            self.findings.append(finding)


def ui_parameter(path: tuple[str, ...]) -> str:
    return "_".join(re.sub(r"\W", "_", p) for p in path)


def like_pattern(pattern: str) -> str:
    """* and ? as % and _; % and _ of the pattern itself escaped."""
    return "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_"}.get(c, c) for c in pattern)


class _Renderer:
    def __init__(self, out: Analysis, known: frozenset[str]):
        self.out, self.known = out, known

    def text(self, n: Node) -> str:
        return getattr(self, f"_{n.kind}")(n)

    def _string(self, n: Node) -> str:
        return "'" + n.value.replace("'", "''") + "'"

    def _number(self, n: Node) -> str:
        return n.value

    def _date(self, n: Node) -> str:
        return f"DATE '{n.value}'"

    def _bool(self, n: Node) -> str:
        return n.value.upper()

    def _null(self, n: Node) -> str:
        return "NULL"

    def _group(self, n: Node) -> str:
        return f"({self.text(n.children[0])})"

    def _star(self, n: Node) -> str:
        return ".".join(p if p == "*" else identifier(p) for p in n.path)

    def _name(self, n: Node) -> str:
        return self._path(n)

    def _member(self, n: Node) -> str:
        return self._path(n)

    def _path(self, n: Node) -> str:
        root = n.path[0].lower()
        shown = ".".join(n.path)
        if len(n.path) > 1 and root in UI_ROOTS:
            name = ui_parameter(n.path)
            self.out.ui_references.append(shown)
            if name not in self.out.parameters:
                self.out.parameters.append(name)
            self.out.add("UI_REFERENCE_BECOMES_PARAMETER", shown)
            return f":{name}"
        if len(n.path) > 1 and root in HOST_ROOTS:
            self.out.add("ACCESS_OBJECT_MODEL_REFERENCE", shown)
            return f"/* {shown} */ NULL"
        if shown not in self.out.identifiers:
            self.out.identifiers.append(shown)
        return ".".join(map(identifier, n.path))

    def _unary(self, n: Node) -> str:
        inner = self.text(n.children[0])
        return f"NOT {inner}" if n.value == "not" else f"{n.value}{inner}"

    def _isnull(self, n: Node) -> str:
        return f"{self.text(n.children[0])} IS {'NOT ' * n.negated}NULL"

    def _between(self, n: Node) -> str:
        value, low, high = map(self.text, n.children)
        return f"{value} {'NOT ' * n.negated}BETWEEN {low} AND {high}"

    def _in(self, n: Node) -> str:
        value, *items = map(self.text, n.children)
        return f"{value} {'NOT ' * n.negated}IN ({', '.join(items)})"

    def _like(self, n: Node) -> str:
        pattern = n.children[1]
        self.out.add("LIKE_WILDCARD_DIALECT", self.text(pattern))
        right = self._string(Node("string", like_pattern(pattern.value))) if pattern.kind == "string" else self.text(pattern)
        return f"{self.text(n.children[0])} {'NOT ' * n.negated}LIKE {right}"

    def _binary(self, n: Node) -> str:
        left, right = map(self.text, n.children)
        op = n.value
        if op in ("eqv", "imp"):
            self.out.add("LOGICAL_OPERATOR_NOT_IN_SQL", op.upper())
            return f"({left} = {right})" if op == "eqv" else f"(NOT ({left}) OR {right})"
        if op == "\\":
            self.out.add("INTEGER_DIVISION_SEMANTICS", f"{left} \\ {right}")
            return f"TRUNC({left} / {right})"
        if op == "mod":
            return f"MOD({left}, {right})"
        if op == "^":
            return f"POWER({left}, {right})"
        if op == "xor":
            return f"(({left}) <> ({right}))"
        return f"{left} {'||' if op == '&' else op.upper()} {right}"

    def _call(self, n: Node) -> str:
        name = n.path[-1].lower().rstrip("$")
        if name not in self.out.functions:
            self.out.functions.append(name)
        args = [self.text(a) for a in n.children]
        plain = f"{'.'.join(n.path)}({', '.join(args)})"
        support = support_of(name)
        if support is None:
            code = "OBJECT_METHOD_CALL" if len(n.path) > 1 else "USER_DEFINED_VBA_FUNCTION" if name in self.known else "UNKNOWN_FUNCTION"
            self.out.add(code, ".".join(n.path))
            return plain
        if support == "runtime":
            self.out.add("ACCESS_RUNTIME_FUNCTION", name)
            return plain
        if support == "sql":
            target = DIRECT[name]
            return target if target.startswith("CURRENT_") else f"{target}({', '.join(args)})"
        made = self._rewritten(name, args)
        if made is None:
            self.out.add("FUNCTION_REWRITE_INCOMPLETE", name)
            return plain
        return made

    def _rewritten(self, name: str, a: list[str]) -> str | None:
        n = len(a)
        if name == "iif" and n in (2, 3):
            return f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2] if n == 3 else 'NULL'} END"
        if name == "isnull" and n == 1:
            return f"({a[0]} IS NULL)"
        if name == "nz" and n in (1, 2):
            if n == 1:
                self.out.add("NZ_DEFAULT_DEPENDS_ON_TYPE", a[0])
            return f"COALESCE({a[0]}, {a[1] if n == 2 else 'NULL'})"
        if name in ("year", "month", "day", "hour", "minute", "second") and n == 1:
            return f"EXTRACT({name.upper()} FROM {a[0]})"
        if name == "mid" and n in (2, 3):
            return f"SUBSTRING({a[0]} FROM {a[1]}{f' FOR {a[2]}' if n == 3 else ''})"
        if name == "instr" and n == 2:
            return f"POSITION({a[1]} IN {a[0]})"
        if name == "space" and n == 1:
            return f"REPEAT(' ', {a[0]})"
        if name in ("int", "fix") and n == 1:
            self.out.add("INT_FIX_ROUNDING", name)
            return f"FLOOR({a[0]})"
        if name == "switch" and n and n % 2 == 0:
            return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in zip(a[::2], a[1::2], strict=True)) + " END"
        if name in _CASTS and n == 1:
            return f"CAST({a[0]} AS {_CASTS[name]})"
        return None


@functools.lru_cache(maxsize=64)
def _lowered(names: frozenset[str]) -> frozenset[str]:
    return frozenset(n.lower() for n in names)


def analyse(source: str | None, known_functions: frozenset[str] | set[str] = frozenset()) -> Analysis:
    """Parses and renders an expression; a failure to parse is a finding, not an exception."""
    out = Analysis(source or "")
    try:
        out.tree = parse(source or "")
        if out.tree is not None and any(n.kind in SUBQUERIES for n in walk(out.tree)):
            raise ParseError("a SELECT has no form as an expression")
    except ParseError as error:
        out.parse_error = str(error)
        out.add("EXPRESSION_PARSE_FAILED", source or "", str(error))
        return out
    if out.tree is not None:
        out.sql = _Renderer(out, _lowered(frozenset(known_functions))).text(out.tree)
    return out
