"""Macros and data macros: their statements as trees, from XML or flat lists."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.etree import ElementTree

from gridspark.functions.registry import Finding
from gridspark.plans.textformat import Block

from .schema import safe_xml

#: Macro actions by category.
ACTIONS = {
    "data": """SetField SetLocalVar LookUpRecord ForEachRecord CreateRecord EditRecord DeleteRecord RunDataMacro RaiseError ClearMacroError
        SetReturnVar CreateSharePointRecord""",
    "control": "StopMacro StopAllMacros OnError ExitForEachRecord Comment Group SubMacro If Else ElseIf",
    "ui": """OpenForm OpenReport OpenQuery OpenTable OpenView OpenStoredProcedure CloseWindow Close GoToRecord GoToControl GoToPage FindRecord FindNext
        ApplyFilter RemoveFilter Requery RepaintObject RefreshRecord SetValue SetProperty SetFilter SetOrderBy SetDisplayedCategories SelectObject
        MaximizeWindow MinimizeWindow RestoreWindow MoveAndSizeWindow MessageBox Beep NavigateTo BrowseTo LockNavigationPane ShowAllRecords
        SearchForRecord PrintObject PrintPreview AddMenu SetMenuItem ShowToolbar RunMenuCommand SingleStep RedisplayRecords RefreshAllData
        UndoRecord SaveRecord NewObjectForm NewObjectReport""",
    "system": """RunCode RunMacro RunApplication RunSQL RunSavedImportExport QuitAccess Quit CopyObject DeleteObject RenameObject SaveObject OutputTo
        SendObject TransferDatabase TransferSpreadsheet TransferText ImportExportData ImportExportSpreadsheet ImportExportText SetWarnings
        SetLocalVarEcho Echo Hourglass DisplayHourglassPointer CancelEvent StopAllMacrosOnError""",
}
CATEGORY = {name.casefold(): kind for kind, names in ACTIONS.items() for name in names.split()}


def category(action: str) -> str:
    return CATEGORY.get(action.casefold(), "unknown")


@dataclass
class Statement:
    """kind: action, conditional, block, comment or unknown_element. `branches`: (name, condition, statements)."""

    kind: str
    name: str = ""
    arguments: dict[str, str] = field(default_factory=dict)
    condition: str | None = None
    branches: list[tuple[str, str | None, list[Statement]]] = field(default_factory=list)
    statements: list[Statement] = field(default_factory=list)
    text: str = ""

    @property
    def category(self) -> str:
        return category(self.name)

    def walk(self):
        yield self
        for _, _, inner in self.branches:
            for s in inner:
                yield from s.walk()
        for s in self.statements:
            yield from s.walk()


@dataclass
class Handler:
    event: str
    statements: list[Statement]

    @property
    def timing(self) -> str:
        return "before" if self.event.lower().startswith("before") else "after"

    @property
    def operation(self) -> str:
        event = self.event.casefold()
        return "delete" if "delete" in event else "insert" if "insert" in event else "insert_or_update" if "change" in event or "update" in event else "unknown"


@dataclass
class MacroModel:
    name: str
    representation: str
    handlers: list[Handler]
    findings: list[Finding] = field(default_factory=list)

    @property
    def translated(self) -> bool:
        return bool(self.handlers) and not any(f.blocking for f in self.findings)

    def census(self) -> dict[str, list[str]]:
        """Category to its sorted distinct actions."""
        out: dict[str, set[str]] = {}
        for h in self.handlers:
            for top in h.statements:
                for s in top.walk():
                    if s.kind == "action":
                        out.setdefault(s.category, set()).add(s.name)
        return {k: sorted(v) for k, v in sorted(out.items())}


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((c for c in e if _local(c) == name), None)


def _report(model: MacroModel, action: str) -> None:
    kind = category(action)
    if kind not in ("data", "control"):
        finding = Finding(f"MACRO_ACTION_{kind.upper()}_NOT_TRANSLATABLE", action)
        if finding not in model.findings:
            model.findings.append(finding)


def _statements(e: ElementTree.Element, model: MacroModel) -> list[Statement]:
    inner = _child(e, "Statements")
    out = []
    for c in e if inner is None else inner:
        name = _local(c)
        if name == "Action":
            action = c.get("Name", "")
            out.append(Statement("action", action, {a.get("Name", ""): a.text or "" for a in c if _local(a) == "Argument"} | {f"Parameter:{a.get('Name', '')}": a.get("Value") or a.text or "" for p in c if _local(p) == "Parameters" for a in p}))
            _report(model, action)
        elif name == "ConditionalBlock":
            branches = []
            for b in c:
                condition = _child(b, "Condition")
                branches.append((_local(b).lower(), condition.text if condition is not None else None, _statements(b, model)))
            out.append(Statement("conditional", branches=branches))
        elif name == "Comment":
            out.append(Statement("comment", text=c.text or ""))
        elif name in ("LookUpRecord", "ForEachRecord", "CreateRecord", "EditRecord", "SubMacro", "Group", "UserInterfaceMacro"):
            data = _child(c, "Data")
            arguments = {} if data is None else {**{k: v for k, v in data.attrib.items()}, **{_local(x): (x.text or "") for x in data}}
            if data is not None and _child(data, "Reference") is not None:
                arguments["Reference"] = _child(data, "Reference").text or ""
            out.append(Statement("block", name, arguments | dict(c.attrib), statements=_statements(c, model)))
        elif name not in ("Data", "Condition"):
            out.append(Statement("unknown_element", name))
            model.findings.append(Finding("MACRO_ELEMENT_NOT_RECOGNISED", name))
    return out


def read_data_macros(xml: str, table: str) -> MacroModel:
    """The event handlers of a table."""
    model = MacroModel(table, "axl", [])
    for e in safe_xml(xml).iter():
        if _local(e) == "DataMacro":
            model.handlers.append(Handler(e.get("Event") or e.get("Name") or "Unnamed", _statements(e, model)))
    return model


def read_macro(block: Block, name: str) -> MacroModel:
    """A macro: its embedded XML where there is some, else the flat list of actions."""
    faults: list[Finding] = []
    for b in block.children:
        comment = "".join(b.all("Comment"))
        if comment.startswith("_AXL:"):
            model = MacroModel(name, "axl", [])
            try:
                root = safe_xml(comment[5:])
            except (ValueError, ElementTree.ParseError) as error:
                faults = [Finding("MACRO_AXL_NOT_PARSED", str(error))]
                break
            model.handlers.append(Handler("run", _statements(root, model)))
            return model
    model = MacroModel(name, "legacy_action_list", [], [*faults, Finding("MACRO_STORED_AS_FLAT_ACTION_LIST", name)])
    rows = []
    for b in block.children:
        action = b.get("Action")
        if action:
            rows.append(Statement("action", action, {str(i): v for i, v in enumerate(b.all("Argument"))}, b.get("Condition")))
            _report(model, action)
    model.handlers.append(Handler("run", rows))
    return model
