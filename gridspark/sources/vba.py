"""Module code: lines, procedures, statement trees, effects, metrics and control flow."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

#: Names that reach outside the database, by reason code.
EFFECTS = {
    "docmd": "VBA_DRIVES_ACCESS_UI",
    "msgbox": "VBA_INTERACTIVE_DIALOG",
    "inputbox": "VBA_INTERACTIVE_DIALOG",
    "shell": "VBA_STARTS_EXTERNAL_PROCESS",
    "createobject": "VBA_AUTOMATION_OBJECT",
    "getobject": "VBA_AUTOMATION_OBJECT",
    "sendkeys": "VBA_SENDS_KEYSTROKES",
    "kill": "VBA_FILE_SYSTEM_ACCESS",
    "open": "VBA_FILE_SYSTEM_ACCESS",
    "filecopy": "VBA_FILE_SYSTEM_ACCESS",
    "mkdir": "VBA_FILE_SYSTEM_ACCESS",
    "environ": "VBA_HOST_ENVIRONMENT",
    "application": "VBA_ACCESS_APPLICATION_OBJECT",
    "screen": "VBA_ACCESS_APPLICATION_OBJECT",
    "forms": "VBA_ACCESS_FORM_REFERENCE",
    "reports": "VBA_ACCESS_REPORT_REFERENCE",
}
DATA_NAMES = frozenset({"currentdb", "recordset", "openrecordset", "execute", "runsql", "querydefs", "tabledefs", "dbengine", "dlookup", "dcount", "dsum"})
_HEAD = re.compile(r"(?:(?P<scope>Public|Private|Friend)\s+)?(?P<static>Static\s+)?(?P<kind>Sub|Function|Property\s+(?:Get|Let|Set))\s+(?P<name>\w+)\s*(?:\((?P<params>.*)\))?(?:\s+As\s+(?P<returns>[\w.]+))?\s*$", re.I)
_END = re.compile(r"End\s+(Sub|Function|Property)$", re.I)
_STRING = re.compile(r'"(?:[^"]|"")*"')
_SQL = re.compile(r"^\s*(SELECT|INSERT|UPDATE|DELETE|TRANSFORM|CREATE|ALTER|DROP)\b", re.I)


@dataclass(frozen=True)
class Line:
    number: int
    code: str


@dataclass
class Parameter:
    name: str
    type: str | None
    optional: bool
    by_ref: bool
    default: str | None


@dataclass
class Stmt:
    """type: if, select_case, for, for_each, while, do_loop, with, on_error, goto, resume, exit, label,
    declaration or statement. `arms`: (kind, condition, statements) of if and select_case."""

    type: str
    source: str
    line: int
    statements: list[Stmt] = field(default_factory=list)
    arms: list[tuple[str, str, list[Stmt]]] = field(default_factory=list)

    def walk(self):
        yield self
        for s in self.statements:
            yield from s.walk()
        for _, _, inner in self.arms:
            for s in inner:
                yield from s.walk()


@dataclass
class Procedure:
    name: str
    kind: str
    scope: str
    returns: str | None
    parameters: list[Parameter]
    statements: list[Stmt]
    lines: list[Line]


@dataclass
class Module:
    name: str
    declarations: list[str]
    procedures: list[Procedure]


def _without_comment(text: str) -> str:
    inside = False
    for i, c in enumerate(text if "'" in text else ""):
        if c == '"':
            inside = not inside
        elif c == "'" and not inside:
            return text[:i]
    return "" if re.match(r"\s*Rem\b", text, re.I) else text


def _parts(code: str) -> list[str]:
    """Statements of a line, cut at colons outside strings; a label keeps its colon."""
    if ":" not in code:
        return [code.strip()] if code.strip() else []
    if re.fullmatch(r"\s*[A-Za-z_]\w*:\s*", code):
        return [code.strip()]
    out, last, inside = [], 0, False
    for i, c in enumerate(code):
        if c == '"':
            inside = not inside
        elif c == ":" and not inside and code[i + 1 : i + 2] != "=":
            out.append(code[last:i])
            last = i + 1
    out.append(code[last:])
    return [p.strip() for p in out if p.strip()]


def logical_lines(text: str) -> list[Line]:
    """Statements with their line numbers: comments, continuations and written line numbers taken out."""
    out, held, first = [], "", 0
    for number, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        code = _without_comment(raw).rstrip()
        if not held:
            first = number
            code = re.sub(r"^\s*\d+(?=\s|$)", "", code)
        if re.search(r"\s_$", code):
            held += code[:-1]
            continue
        out += [Line(first, p) for p in _parts(held + code)]
        held = ""
    return out


def _parameters(text: str | None) -> list[Parameter]:
    out = []
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        m = re.fullmatch(r"(?P<opt>Optional\s+)?(?:(?P<by>ByVal|ByRef)\s+)?(?:ParamArray\s+)?(?P<name>\w+)(?:\(\))?(?:\s+As\s+(?P<type>[\w.]+))?(?:\s*=\s*(?P<default>.+))?", part, re.I)
        if m:
            out.append(Parameter(m["name"], m["type"], bool(m["opt"]), (m["by"] or "ByRef").lower() == "byref", m["default"]))
    return out


_OPEN = [
    ("select_case", re.compile(r"Select\s+Case\b", re.I), re.compile(r"End\s+Select$", re.I)),
    ("for_each", re.compile(r"For\s+Each\b", re.I), re.compile(r"Next\b", re.I)),
    ("for", re.compile(r"For\b", re.I), re.compile(r"Next\b", re.I)),
    ("while", re.compile(r"While\b", re.I), re.compile(r"Wend$", re.I)),
    ("do_loop", re.compile(r"Do\b", re.I), re.compile(r"Loop\b", re.I)),
    ("with", re.compile(r"With\b", re.I), re.compile(r"End\s+With$", re.I)),
]
_PLAIN = [
    ("on_error", re.compile(r"On\s+Error\b", re.I)),
    ("goto", re.compile(r"GoTo\b", re.I)),
    ("resume", re.compile(r"Resume\b", re.I)),
    ("exit", re.compile(r"(Exit\s+(Sub|Function|Property|For|Do)|End)$", re.I)),
    ("label", re.compile(r"\w+:$")),
    ("declaration", re.compile(r"(Dim|Const|Static|ReDim)\b", re.I)),
]


def _split_else(text: str) -> tuple[str, str | None]:
    """The then part and the else part of a one-line If, cut at Else outside strings."""
    masked = _STRING.sub(lambda m: "x" * len(m[0]), text)
    m = re.search(r"\bElse\b", masked, re.I)
    return (text, None) if m is None else (text[: m.start()].strip(), text[m.end() :].strip())


class _Tree:
    def __init__(self, lines: list[Line]):
        self.lines, self.at = lines, 0

    def until(self, *ends: re.Pattern) -> list[Stmt]:
        out = []
        while self.at < len(self.lines):
            code = self.lines[self.at].code
            if any(e.match(code) for e in ends):
                return out
            out.append(self.one())
        return out

    def one(self) -> Stmt:
        line = self.lines[self.at]
        self.at += 1
        code = line.code
        m = re.match(r"If\b(.+?)\bThen\b\s*(.*)$", code, re.I)
        if m:
            return self._if(line, m[1].strip(), m[2].strip())
        for kind, start, end in _OPEN:
            if start.match(code):
                s = Stmt(kind, code, line.number)
                if kind == "select_case":
                    self._cases(s, end)
                else:
                    s.statements = self.until(end)
                    self.at += 1
                return s
        for kind, pattern in _PLAIN:
            if pattern.match(code):
                return Stmt(kind, code, line.number)
        return Stmt("statement", code, line.number)

    def _if(self, line: Line, condition: str, rest: str) -> Stmt:
        s = Stmt("if", line.code, line.number)
        if rest:
            then, other = _split_else(rest)
            s.arms.append(("if", condition, [_Tree([Line(line.number, then)]).one()]))
            if other is not None:
                s.arms.append(("else", "", [_Tree([Line(line.number, other)]).one()]))
            return s
        ends = [re.compile(p, re.I) for p in (r"ElseIf\b", r"Else$", r"End\s+If$")]
        kind = "if"
        while True:
            s.arms.append((kind, condition, self.until(*ends)))
            if self.at >= len(self.lines):
                return s
            code = self.lines[self.at].code
            self.at += 1
            if ends[2].match(code):
                return s
            kind = "elseif" if ends[0].match(code) else "else"
            m = re.match(r"ElseIf\b(.+?)\bThen$", code, re.I)
            condition = m[1].strip() if m else ""

    def _cases(self, s: Stmt, end: re.Pattern) -> None:
        case = re.compile(r"Case\b", re.I)
        self.until(case, end)
        while self.at < len(self.lines):
            code = self.lines[self.at].code
            self.at += 1
            if end.match(code):
                return
            value = code[4:].strip()
            s.arms.append(("else" if value.lower() == "else" else "case", value, self.until(case, end)))


def _cut(text: str) -> tuple[list[str], list[tuple[re.Match, list[Line]]]]:
    """A module's declarations, and the head and the lines of each procedure that ends."""
    declarations, procedures, current, body = [], [], None, []
    for line in logical_lines(text):
        head = _HEAD.match(line.code) if current is None else None
        if head:
            current, body = head, []
        elif current is not None and _END.match(line.code):
            procedures.append((current, body))
            current = None
        elif current is not None:
            body.append(line)
        else:
            declarations.append(line.code)
    return declarations, procedures


def procedure_names(text: str) -> list[str]:
    """The names of a module's procedures, without their statements."""
    return [head["name"] for head, _ in _cut(text)[1]]


def read_module(text: str, name: str) -> Module:
    """A module's declarations and procedures, with their statement trees."""
    declarations, procedures = _cut(text)
    whole = [Procedure(head["name"], head["kind"].lower().replace(" ", "_"), (head["scope"] or "public").lower(), head["returns"], _parameters(head["params"]), _Tree(body).until(), body) for head, body in procedures]
    return Module(name, declarations, whole)


def metrics(p: Procedure) -> dict[str, int]:
    """Counts over a procedure's statements; every arm of a branch counts."""
    all_ = [s for top in p.statements for s in top.walk()]
    branches = sum(len(s.arms) for s in all_ if s.type in ("if", "select_case"))
    loops = sum(s.type in ("for", "for_each", "while", "do_loop") for s in all_)
    of = lambda kind: sum(s.type == kind for s in all_)
    return {"statements": len(all_), "branches": branches, "loops": loops, "exits": of("exit"), "gotos": of("goto"), "labels": of("label"), "cyclomatic_complexity": 1 + branches + loops}


@functools.lru_cache(maxsize=64)
def _folded(names: frozenset[str]) -> dict[str, str]:
    return {n.casefold(): n for n in sorted(names)}


def effects(p: Procedure, known: set[str] | frozenset[str] = frozenset()) -> dict[str, list[str]]:
    """Calls of known procedures, DoCmd actions, SQL literals and codes of external effects."""
    found: dict[str, list[str]] = {"calls": [], "docmd_actions": [], "docmd_targets": [], "sql_literals": [], "external": [], "data_access": []}
    folded = _folded(frozenset(known))

    def put(kind: str, value: str) -> None:
        if value not in found[kind]:
            found[kind].append(value)

    for line in p.lines:
        for literal in _STRING.findall(line.code):
            if _SQL.match(literal[1:-1]):
                put("sql_literals", literal[1:-1].replace('""', '"'))
        bare = _STRING.sub('""', line.code)
        for m in re.finditer(r"\bDoCmd\s*\.\s*(\w+)", bare, re.I):
            put("docmd_actions", m[1])
            target = re.search(rf'\bDoCmd\s*\.\s*{m[1]}\b[^"]*"((?:[^"]|"")*)"', line.code, re.I)
            if target:
                put("docmd_targets", f"{m[1].lower()}:{target[1]}")
        for word in re.findall(r"(?<![.\w])([A-Za-z_]\w*)", bare):
            low = word.casefold()
            if low in EFFECTS:
                put("external", EFFECTS[low])
            if low in folded and low != p.name.casefold():
                put("calls", folded[low])
        for word in re.findall(r"[A-Za-z_]\w*", bare):
            if word.casefold() in DATA_NAMES:
                put("data_access", word)
    return found


def module_findings(module: Module, external: list[str] | None = None) -> list[str]:
    """Codes of the external effects of a module, declarations included; `external` are those of its procedures, if known."""
    codes = [c for p in module.procedures for c in effects(p)["external"]] if external is None else list(external)
    if any(re.match(r"(?:Public\s+|Private\s+)?Declare\b", d, re.I) for d in module.declarations):
        codes.append("VBA_DECLARES_EXTERNAL_LIBRARY")
    return list(dict.fromkeys(codes))


@dataclass
class Flow:
    nodes: list[tuple[int, str, str, int]] = field(default_factory=list)  # id, kind, label, line
    edges: list[tuple[int, int, str]] = field(default_factory=list)

    def node(self, kind: str, label: str = "", line: int = 0) -> int:
        label = re.sub(r"\s+", " ", label)
        self.nodes.append((len(self.nodes), kind, label if len(label) <= 90 else label[:89] + "…", line))
        return len(self.nodes) - 1

    def edge(self, a: int, b: int, label: str = "") -> None:
        if (a, b, label) not in self.edges:
            self.edges.append((a, b, label))


def control_flow(p: Procedure) -> Flow:
    """The control-flow graph of a procedure. Ends of a part are (node, label of the edge to come)."""
    flow = Flow()
    labels: dict[str, int] = {}
    jumps: list[tuple[int, str, str]] = []
    start = flow.node("start", p.name)
    end_of_all: list[tuple[int, str]] = []

    def connect(ends: list[tuple[int, str]], to: int) -> None:
        for a, label in ends:
            flow.edge(a, to, label)

    def kind_of(s: Stmt) -> str:
        if s.type in ("declaration", "label", "goto", "exit"):
            return s.type
        if s.type in ("on_error", "resume"):
            return "error"
        low = s.source.lower()
        if re.search(r"\b(docmd|msgbox|inputbox|forms|reports|screen)\b", low):
            return "ui"
        if re.search(r"\b(open|close|print|kill|filecopy|mkdir|shell)\b", low):
            return "io"
        return "data" if any(re.search(rf"\b{n}\b", low) for n in DATA_NAMES) else "process"

    def sequence(statements: list[Stmt], ends: list[tuple[int, str]], breaks: list[tuple[int, str]]) -> list[tuple[int, str]]:
        for s in statements:
            ends = one(s, ends, breaks)
        return ends

    def one(s: Stmt, ends: list[tuple[int, str]], breaks: list[tuple[int, str]]) -> list[tuple[int, str]]:
        if s.type == "if":
            out: list[tuple[int, str]] = []
            for kind, condition, inner in s.arms:
                if kind == "else":
                    out += sequence(inner, ends, breaks)
                    ends = []
                    continue
                d = flow.node("decision", condition, s.line)
                connect(ends, d)
                out += sequence(inner, [(d, "yes")], breaks)
                ends = [(d, "no")]
            return merged(out + ends, s.line)
        if s.type == "select_case":
            d = flow.node("decision", s.source, s.line)
            connect(ends, d)
            out = []
            for kind, value, inner in s.arms:
                out += sequence(inner, [(d, "Case Else" if kind == "else" else f"Case {value}")], breaks)
            if not any(kind == "else" for kind, _, _ in s.arms):
                out.append((d, "no_match"))
            return merged(out, s.line)
        if s.type in ("for", "for_each", "while", "do_loop"):
            loop = flow.node("loop", s.source, s.line)
            connect(ends, loop)
            inner_breaks: list[tuple[int, str]] = []
            for a, label in sequence(s.statements, [(loop, "loop_body")], inner_breaks):
                flow.edge(a, loop, label if a == loop else "loop_next")
            return [(loop, "loop_exit"), *inner_breaks]
        if s.type == "with":
            return sequence(s.statements, ends, breaks)
        n = flow.node(kind_of(s), s.source, s.line)
        connect(ends, n)
        low = s.source.lower()
        if s.type == "label":
            labels[low.rstrip(":")] = n
        elif s.type == "goto":
            jumps.append((n, low.split()[-1], "goto"))
            return []
        elif s.type == "on_error" and "goto" in low and low.split()[-1] not in ("0", "-1"):
            jumps.append((n, low.split()[-1], "on_error"))
        elif s.type == "resume" and low not in ("resume", "resume next"):
            jumps.append((n, low.split()[-1], "goto"))
            return []
        elif s.type == "exit":
            if re.search(r"\b(for|do)$", low):
                breaks.append((n, "break"))
            else:
                end_of_all.append((n, ""))
            return []
        return [(n, "")]

    def merged(ends: list[tuple[int, str]], line: int) -> list[tuple[int, str]]:
        if len(ends) < 2:
            return ends
        m = flow.node("merge", "", line)
        connect(ends, m)
        return [(m, "")]

    last = sequence(p.statements, [(start, "")], [])
    end = flow.node("end", p.name)
    connect(last + end_of_all, end)
    for a, label, kind in jumps:
        flow.edge(a, labels.get(label, end), kind)
    return flow
