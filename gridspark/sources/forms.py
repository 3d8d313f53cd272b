"""Forms and reports: sections, controls, bindings, events and group levels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from gridspark.functions.neutral import analyse
from gridspark.functions.registry import Finding
from gridspark.plans.model import source_tables
from gridspark.plans.textformat import Block, parse_text, split_code

#: Section types, and event properties whose handler suffix is not their name without On.
SECTIONS = frozenset("FormHeader FormFooter PageHeader PageFooter Section ReportHeader ReportFooter GroupHeader GroupFooter BreakHeader BreakFooter".split())
EVENTS = frozenset(
    """OnCurrent OnLoad OnUnload OnOpen OnClose OnClick OnDblClick OnChange OnEnter OnExit OnGotFocus OnLostFocus OnTimer OnError OnDirty OnUndo
    OnResize OnActivate OnDeactivate OnDelete OnFilter OnApplyFilter OnNoData OnPage OnFormat OnPrint OnRetreat OnNotInList OnKeyDown OnKeyUp
    OnKeyPress OnMouseDown OnMouseUp OnMouseMove OnMouseWheel BeforeUpdate AfterUpdate BeforeInsert AfterInsert BeforeDelConfirm AfterDelConfirm
    AfterFinalRender""".split()
)
UNPORTABLE = frozenset({"CustomControl", "ActiveXControl", "BoundObjectFrame", "UnboundObjectFrame", "ObjectFrame", "WebBrowser", "Chart", "Attachment"})
_EVENT = re.compile(r"(On|Before|After)[A-Z]\w*")


def suffix(event: str) -> str:
    return event[2:] if event.startswith("On") else event


@dataclass(frozen=True)
class Binding:
    """kind: column, calculated, row_source, value_list or subform."""

    kind: str
    source: str
    sql: str | None = None
    link_child: tuple[str, ...] = ()
    link_master: tuple[str, ...] = ()
    bound_column: int | None = None


@dataclass(frozen=True)
class Event:
    owner: str
    event: str
    handler_kind: str
    handler: str | None


@dataclass
class Control:
    name: str
    type: str
    section: str
    parent: str | None
    bindings: list[Binding] = field(default_factory=list)
    geometry: dict[str, int] = field(default_factory=dict)


@dataclass
class GroupLevel:
    source: str
    descending: bool
    group_on: str | None
    interval: str | None


@dataclass
class FormModel:
    name: str
    kind: str
    record_source: str | None = None
    filter: str | None = None
    filter_on: bool = False
    order_by: str | None = None
    order_by_on: bool = False
    sections: list[str] = field(default_factory=list)
    style_defaults: list[str] = field(default_factory=list)
    controls: list[Control] = field(default_factory=list)
    events: list[Event] = field(default_factory=list)
    group_levels: list[GroupLevel] = field(default_factory=list)
    dependencies: list[str] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)
    code: str | None = None


def _on(value: str | None) -> bool:
    return (value or "").strip().lower() not in ("", "0", "false", "no", "notdefault") if value is not None else False


def _event(owner: str, prefix: str, key: str, value: str, model: FormModel) -> None:
    text = value.strip()
    if not text:
        return
    if text == "[Event Procedure]":
        kind, handler = "vba_procedure", f"{prefix}_{suffix(key)}"
    elif text == "[Embedded Macro]":
        kind, handler = "embedded_macro", None
        model.findings.append(Finding("EMBEDDED_MACRO_BODY_NOT_IN_TEXT_DEFINITION", f"{owner}.{key}"))
    elif text.startswith("="):
        kind, handler = "expression", text[1:]
    else:
        kind, handler = "macro_object", text
    model.events.append(Event(owner, key, kind, handler))


def _depend(model: FormModel, source: str) -> None:
    names = source_tables(source) if re.match(r"\s*SELECT\b", source, re.I) else [source.strip()]
    model.dependencies += [n for n in names if n and n not in model.dependencies]


def _bindings(b: Block, model: FormModel) -> list[Binding]:
    out = []
    source = (b.get("ControlSource") or "").strip()
    if source.startswith("="):
        a = analyse(source)
        model.findings += [f for f in a.findings if f not in model.findings]
        out.append(Binding("calculated", source, a.sql))
    elif source:
        out.append(Binding("column", source))
    rows = (b.get("RowSource") or "").strip()
    if rows:
        bound = b.get("BoundColumn")
        if (b.get("RowSourceType") or "Table/Query").strip().lower() == "table/query":
            out.append(Binding("row_source", rows, bound_column=int(bound) if bound and bound.isdigit() else None))
            _depend(model, rows)
        else:
            out.append(Binding("value_list", rows))
            model.findings.append(Finding("ROW_SOURCE_TYPE_NOT_A_QUERY", b.get("Name") or rows))
    inner = (b.get("SourceObject") or "").strip()
    if inner:
        split = lambda k: tuple(x.strip() for x in (b.get(k) or "").split(";") if x.strip())
        out.append(Binding("subform", inner, link_child=split("LinkChildFields"), link_master=split("LinkMasterFields")))
    return out


def _controls(b: Block, section: str, parent: str | None, model: FormModel) -> None:
    for c in b.children:
        name = c.get("Name")
        if c.type_name is None or name is None:
            _controls(c, section, parent, model)
            continue
        box = {k.lower(): int(v) for k in ("Left", "Top", "Width", "Height") if (v := c.get(k)) and v.lstrip("-").isdigit()}
        model.controls.append(Control(name, c.type_name, section, parent, _bindings(c, model), box))
        if c.type_name in UNPORTABLE:
            model.findings.append(Finding("CONTROL_TYPE_HAS_NO_PORTABLE_EQUIVALENT", f"{name}: {c.type_name}"))
        for p in c.properties:
            if p.key in EVENTS or (_EVENT.fullmatch(p.key) and p.value in ("[Event Procedure]", "[Embedded Macro]")):
                _event(name, name, p.key, p.value, model)
        _controls(c, section, name, model)


def read_form(text: str, name: str, kind: str = "form") -> FormModel:
    """The model of a form or report from its definition text."""
    body, code = split_code(text)
    model = FormModel(name, kind, code=code)
    root = next((b for b in parse_text(body).walk() if (b.type_name or "").lower() == kind), None)
    if root is None:
        model.findings.append(Finding("OBJECT_BLOCK_NOT_FOUND", name))
        return model
    model.record_source = root.get("RecordSource") or None
    if model.record_source:
        _depend(model, model.record_source)
    model.filter, model.filter_on = root.get("Filter") or None, _on(root.get("FilterOn"))
    model.order_by, model.order_by_on = root.get("OrderBy") or None, _on(root.get("OrderByOn"))
    for p in root.properties:
        if p.key in EVENTS:
            _event(name, kind.capitalize(), p.key, p.value, model)

    def visit(b: Block) -> None:
        for c in b.children:
            if c.type_name == "BreakLevel":
                model.group_levels.append(GroupLevel(c.get("ControlSource") or "", _on(c.get("SortOrder")), c.get("GroupOn"), c.get("GroupInterval")))
            elif c.type_name in SECTIONS and c.get("Name") is not None:
                model.sections.append(c.type_name)
                for p in c.properties:
                    if p.key in EVENTS:
                        _event(c.get("Name"), c.get("Name"), p.key, p.value, model)
                _controls(c, c.get("Name"), None, model)
            elif c.type_name is None:
                visit(c)
            elif c.get("Name") is None:
                model.style_defaults.append(c.type_name)

    visit(root)
    return model
