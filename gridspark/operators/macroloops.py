"""Loops of data macros that carry values from one record to the next.

Sums (v = v + e, whose terms and conditions don't read what is carried) are aggregates of
the matches, whatever their number. Any other recurrence, and loops that raise errors or
stop, are folds: the matches of a row, in the order of their columns, are an array that one
`aggregate` expression goes through; such an array has to fit in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.columns import CompileError, Compiler, Context
from gridspark.functions.grammar import Node, parse, walk
from gridspark.plans.tables import bracketed
from gridspark.sources.macros import Statement

SETTERS = frozenset({"setlocalvar", "setfield", "setreturnvar"})
ENDINGS = frozenset({"raiseerror", "stopmacro", "stopallmacros", "exitforeachrecord"})


def target_of(s: Statement) -> str:
    return (s.arguments.get("Field") or s.arguments.get("Name") or "").split(".")[-1].strip("[]").lower()


def value_of(s: Statement) -> str:
    return s.arguments.get("Value") or s.arguments.get("Expression") or "Null"


def message_of(s: Statement) -> str:
    return next((s.arguments[k] for k in ("Error Description", "Description", "Message") if s.arguments.get(k)), "")


def _own(statements: list[Statement]) -> Iterator[Statement]:
    """Statements of a loop's body and its branches, not of the blocks within it."""
    for s in statements:
        yield s
        for _, _, inner in s.branches:
            yield from _own(inner)


def carried(statements: list[Statement], known: set[str]) -> set[str] | None:
    """What a loop carries: the names known before it that it sets; None for a loop that carries nothing and ends for itself alone."""
    names, ends = set(), False
    for s in _own(statements):
        if s.kind == "action" and s.name.lower() in SETTERS and target_of(s) in known:
            names.add(target_of(s))
        if s.kind == "action" and s.name.lower() in ENDINGS - {"exitforeachrecord"}:
            ends = True
    if not names and not ends:
        return None
    for s in _own(statements):
        if s.kind == "block" or (s.kind == "action" and s.name.lower() not in SETTERS | ENDINGS):
            raise CompileError("MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE", f"{s.name} in a loop that carries values")
    return names


def _reads(text: str | Node | None, names: set[str]) -> bool:
    node = parse(text) if isinstance(text, str) else text
    return node is not None and any(n.kind == "name" and n.path[-1].lower() in names for n in walk(node))


def sums(statements: list[Statement], names: set[str]) -> list[tuple[str, str, Node, tuple[tuple[tuple[str, ...], str | None], ...]]] | None:
    """(variable, + or -, term, conditions) of each assignment of a loop that only sums; None for another loop.

    A condition is (texts of the branches before, own text or None for else).
    """
    local = {target_of(s) for s in _own(statements) if s.kind == "action" and s.name.lower() in SETTERS}
    out: list = []

    def visit(inner: list[Statement], conditions: tuple) -> bool:
        for s in inner:
            if s.kind == "action":
                if s.name.lower() not in SETTERS or target_of(s) not in names:
                    return False
                tree = parse(value_of(s))
                while tree is not None and tree.kind == "group":
                    tree = tree.children[0]
                if tree is None or tree.kind != "binary" or tree.value not in ("+", "-"):
                    return False
                left, right = tree.children
                if tree.value == "+" and right.kind == "name" and right.path[-1].lower() == target_of(s):
                    left, right = right, left
                if left.kind != "name" or left.path[-1].lower() != target_of(s) or _reads(right, local):
                    return False
                out.append((target_of(s), tree.value, right, conditions))
            elif s.kind == "conditional":
                before: tuple[str, ...] = ()
                for name, condition, branch in s.branches:
                    own = condition if name != "else" else None
                    if own and _reads(own, local):
                        return False
                    if not visit(branch, (*conditions, (before, own))):
                        return False
                    before = (*before, own) if own else before
            elif s.kind != "comment":
                return False
        return True

    return out if visit(statements, ()) else None


def condition_column(conditions: tuple, column: Callable[[str], Column]) -> Column:
    """Whether the branches of `conditions` are all taken."""
    out = F.lit(True)
    for before, own in conditions:
        for text in before:
            out = out & ~F.coalesce(column(text), F.lit(False))
        if own:
            out = out & F.coalesce(column(own), F.lit(False))
    return out


class Fold:
    """One loop as an `aggregate` over the array `items` of a row's matches.

    The state has the carried values, `halt` (1: the loop is left, 2: the macro is) and `error`.
    """

    def __init__(self, statements: list[Statement], names: dict[str, str], types: dict[str, str], alias: str, fields: dict[str, str], outer: Context):
        self.statements, self.names, self.types, self.alias, self.fields, self.outer = statements, names, types, alias, fields, outer

    def column(self, items: Column) -> Column:
        start = F.struct(*[F.col(bracketed(c)).cast(self.types[n]).alias(f"v_{n}") for n, c in self.names.items()], F.lit(0).alias("halt"), F.lit(None).cast("string").alias("error"))
        return F.aggregate(items, start, self._step)

    def _step(self, state: Column, item: Column) -> Column:
        self.values = {n: state[f"v_{n}"] for n in self.names}
        self.halt, self.error, self.item = state["halt"], state["error"], item
        self._run(self.statements, F.lit(True))
        return F.struct(*[self.values[n].cast(self.types[n]).alias(f"v_{n}") for n in self.names], self.halt.alias("halt"), self.error.alias("error"))

    def _text(self, text: str) -> Column:
        def resolve(path: tuple[str, ...]) -> Column | None:
            if len(path) > 1 and path[-2].lower() == self.alias:
                field = self.fields.get(path[-1].lower())
                return None if field is None else self.item[field]
            return self.values[path[-1].lower()] if path[-1].lower() in self.values else self.outer.resolve(path)

        return Compiler(Context(resolve, kind=self.outer.kind)).column(parse(text))

    def _run(self, statements: list[Statement], guard: Column) -> None:
        for s in statements:
            live = guard & (self.halt == 0)
            name = s.name.lower()
            if s.kind == "conditional":
                rest, chosen = live, []
                for kind, condition, inner in s.branches:
                    test = F.coalesce(self._text(condition), F.lit(False)) if kind != "else" and condition else F.lit(True)
                    chosen.append((rest & test, inner))
                    rest = rest & ~test
                for taken, inner in chosen:
                    self._run(inner, taken)
            elif s.kind == "action" and name in SETTERS:
                old = self.values.get(target_of(s), F.lit(None))
                value = self._text(value_of(s))
                value = value.cast(self.types[target_of(s)]) if target_of(s) in self.types else value
                self.values = self.values | {target_of(s): F.when(live, value).otherwise(old)}
            elif s.kind == "action" and name == "exitforeachrecord":
                self.halt = F.when(live, 1).otherwise(self.halt)
            elif s.kind == "action" and name == "raiseerror":
                self.error = F.when(live, F.lit(message_of(s))).otherwise(self.error)
                self.halt = F.when(live, 2).otherwise(self.halt)
            elif s.kind == "action":
                self.halt = F.when(live, 2).otherwise(self.halt)
