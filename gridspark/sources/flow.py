"""Control flow of macros and data macros, in the form that procedures have."""

from __future__ import annotations

from .macros import Statement
from .vba import Flow

Ends = list[tuple[int, str]]
_NODE = {"ui": "ui", "system": "io", "data": "data", "control": "process", "unknown": "process"}


def statement_flow(name: str, statements: list[Statement]) -> Flow:
    """Nodes and edges of a handler's statements; loops over records lead back to themselves."""
    flow = Flow()
    stops: Ends = []

    def join(ends: Ends, to: int) -> None:
        for a, label in ends:
            flow.edge(a, to, label)

    def run(items: list[Statement], ends: Ends) -> Ends:
        for s in items:
            ends = step(s, ends)
        return ends

    def step(s: Statement, ends: Ends) -> Ends:
        if s.kind == "comment":
            return ends
        if s.kind == "conditional":
            out: Ends = []
            for branch, condition, inner in s.branches:
                if branch == "else":
                    out += run(inner, ends)
                    ends = []
                else:
                    d = flow.node("decision", condition or "")
                    join(ends, d)
                    out += run(inner, [(d, "yes")])
                    ends = [(d, "no")]
            return out + ends
        if s.kind == "block" and s.name == "ForEachRecord":
            loop = flow.node("loop", s.arguments.get("Reference") or s.name)
            join(ends, loop)
            for a, label in run(s.statements, [(loop, "loop_body")]):
                flow.edge(a, loop, label if a == loop else "loop_next")
            return [(loop, "loop_exit")]
        if s.kind == "block":
            n = flow.node("data", s.name)
            join(ends, n)
            return run(s.statements, [(n, "")])
        if s.condition:
            d = flow.node("decision", s.condition)
            join(ends, d)
            n = flow.node(_NODE[s.category], s.name)
            flow.edge(d, n, "yes")
            return [(n, ""), (d, "no")]
        n = flow.node("exit" if s.name in ("StopMacro", "StopAllMacros") else _NODE.get(s.category, "process"), s.name)
        join(ends, n)
        if s.name in ("StopMacro", "StopAllMacros"):
            stops.append((n, ""))
            return []
        return [(n, "")]

    last = run(statements, [(flow.node("start", name), "")])
    join(last + stops, flow.node("end", name))
    return flow
