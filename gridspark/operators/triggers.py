"""Data macros that fire each other: inserts, edits and deletes of one handler fire the handlers of the tables they touch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gridspark.checkpoints import written
from gridspark.sources.macros import Handler

from .datamacros import run_handler


@dataclass
class Fired:
    """The tables afterwards, the rows that were refused by table, and what fired: (table, event, depth)."""

    tables: dict[str, DataFrame]
    errors: dict[str, DataFrame] = field(default_factory=dict)
    fired: list[tuple[str, str, int]] = field(default_factory=list)


def insert_rows(tables: dict[str, DataFrame], handlers: dict[str, list[Handler]], table: str, rows: DataFrame, named: dict[str, Handler] | None = None, most: int = 10) -> Fired:
    """Inserts `rows` into `table` and runs what that sets off, by rounds: all rows of one table and event at once.

    Handlers before a change may change or refuse rows; those after one may create, edit and delete
    records of other tables, whose handlers run in the next round. Changes that are still there
    after `most` rounds mean handlers that fire each other without an end: an error. A round's rows are
    written, so that nothing is computed twice and the plan stays short.
    """
    out = Fired(dict(tables))
    lookup = {n.casefold(): n for n in tables}
    find = lambda name: out.tables[lookup[name.casefold()]]
    pending: list[tuple[str, str, DataFrame]] = [(table, "insert", rows)]

    def run(name: str, event: str, changed: DataFrame, depth: int):
        for h in handlers.get(name, []):
            if h.event.casefold() == event:
                out.fired.append((name, h.event, depth))
                yield run_handler(h, changed, find, event == "afterinsert" or event == "beforechange", named)

    def refuse(name: str, bad: DataFrame | None) -> None:
        if bad is not None:
            out.errors[name] = out.errors[name].unionByName(bad, allowMissingColumns=True) if name in out.errors else bad

    for depth in range(1, most + 2):
        following: list[tuple[str, str, DataFrame]] = []
        for name, kind, changed in pending:
            changed = written(changed, "fired")
            if changed.isEmpty():
                continue
            if depth > most:
                raise RecursionError(f"{name}: handlers still fire each other after {most} rounds")
            if kind == "insert":
                for made in run(name, "beforechange", changed, depth):
                    refuse(name, made.errors)
                    changed = written(made.rows.select(*changed.columns), "fired")
                out.tables[name] = find(name).unionByName(changed)
            for made in run(name, {"insert": "afterinsert", "update": "afterupdate", "delete": "afterdelete"}[kind], changed, depth):
                refuse(name, made.errors)
                for target, new in made.created.items():
                    following.append((lookup[target.casefold()], "insert", new))
                for target, now in made.edited.items():
                    target = lookup[target.casefold()]
                    before, now = find(target), written(now, "edited")
                    out.tables[target] = now
                    following.append((target, "update", now.exceptAll(before)))
                for target, gone in made.deleted.items():
                    target = name if target == "self" else lookup[target.casefold()]
                    gone = written(gone.select(*find(target).columns), "gone")
                    out.tables[target] = _without(find(target), gone)
                    following.append((target, "delete", gone))
        if not following:
            return out
        pending = following
    return out


def _without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows that equal none of `gone`."""
    keys = gone.distinct().toDF(*[f"__{i}" for i in range(len(gone.columns))])
    on = None
    for i, c in enumerate(df.columns):
        same = df[c].eqNullSafe(keys[f"__{i}"])
        on = same if on is None else on & same
    return df.join(keys, on, "left_anti")
