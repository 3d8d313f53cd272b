"""Data macros as set operations over the rows they fire for.

Every effect is guarded by the condition of its branch, so a handler is a chain of
projections: no row is visited by itself. Lookups and loops are joins with the
distinct values that their conditions read of the firing rows; a loop's rows are kept
apart from the firing rows, but for what it carries from record to record. What stops a handler is a mark on the row that guards
all statements behind it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.columns import CompileError, Compiler, Context, frame_context
from gridspark.functions.grammar import parse, walk
from gridspark.functions.registry import Finding
from gridspark.plans.tables import Tables, bracketed
from gridspark.sources.macros import Handler, Statement

from . import macroloops

#: Named macros that run within each other, at most.
NESTED = 20
#: Columns of rows while a handler runs: whether errors are passed over, and the last one passed over.
_RESUME, _ERROR, _NUMBER = "__resume", "__error_text", "__error_number"


@dataclass
class Outcome:
    """What a handler leaves behind: the rows as they are now; rows to add by table; rows to
    delete by table ("self": firing rows); tables with edited records; rows it refused, with
    `error`; findings of actions that have no effect here."""

    rows: DataFrame
    created: dict[str, DataFrame] = field(default_factory=dict)
    deleted: dict[str, DataFrame] = field(default_factory=dict)
    edited: dict[str, DataFrame] = field(default_factory=dict)
    errors: DataFrame | None = None
    findings: list[Finding] = field(default_factory=list)


@dataclass
class _Record:
    """A looked-up record: its table, and the column of the rows at hand for each of its own."""

    table: str
    columns: dict[str, str]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class _Runner:
    def __init__(self, rows: DataFrame, tables: Tables, is_insert: bool, named: dict[str, Handler] | None = None):
        self.out, self.tables, self.is_insert = Outcome(rows), tables, is_insert
        self.named, self.depth = {k.casefold(): h for k, h in (named or {}).items()}, 0
        self.columns = list(rows.columns)
        self.looked: dict[str, _Record] = {}
        self.current: list[_Record] = []
        self.running: Column | None = None
        self.edits: dict[str, list[tuple[DataFrame, list[str]]]] = {}
        self.in_loop = False
        self.n = 0

    def fresh(self, what: str) -> str:
        self.n += 1
        return f"__{what}_{self.n}"

    def context(self) -> Context:
        base = frame_context(dict(self.out.rows.dtypes))

        def resolve(path: tuple[str, ...]) -> Column | None:
            tail = path[-1].lower()
            if len(path) > 1 and path[-2].lower() in self.looked:
                column = self.looked[path[-2].lower()].columns.get(tail)
                return None if column is None else F.col(bracketed(column))
            if len(path) > 1 and path[-2].lower() == "macroerror":
                column = {"description": _ERROR, "number": _NUMBER}.get(tail)
                here = column in self.out.rows.columns
                return None if column is None else F.col(column) if here else F.lit(None)
            if tail == "isinsert":
                return F.lit(self.is_insert)
            return base.resolve(path)

        return Context(resolve, kind=base.kind)

    def column(self, text: str) -> Column:
        node = parse(text)
        if node is None:
            raise CompileError("EXPRESSION_PARSE_FAILED", "blank")
        return Compiler(self.context()).column(node)

    def run(self, statements: list[Statement], guard: Column | None) -> None:
        for s in statements:
            if s.kind == "conditional":
                self._conditional(s, self._live(guard))
            elif s.kind == "block":
                self._block(s, self._live(guard))
            elif s.kind == "action":
                self._action(s, self._live(guard))

    def _live(self, guard: Column | None) -> Column | None:
        """The guard of a statement: its branch's, for rows that have not been stopped."""
        return guard if self.running is None else self.running if guard is None else guard & self.running

    def _both(self, guard: Column | None, condition: Column) -> Column:
        condition = F.coalesce(condition, F.lit(False))
        return condition if guard is None else guard & condition

    def _hit(self, guard: Column | None) -> DataFrame:
        return self.out.rows if guard is None else self.out.rows.filter(guard)

    def _conditional(self, s: Statement, guard: Column | None) -> None:
        rest, chosen = guard, []
        for name, condition, inner in s.branches:
            mark = self.fresh("branch")
            test = self.column(condition) if name != "else" and condition else F.lit(True)
            # conditions are decided before any branch changes the row
            self.out.rows = self.out.rows.withColumn(mark, self._both(rest, test))
            rest = ~F.col(mark) if rest is None else rest & ~F.col(mark)
            chosen.append((mark, inner))
        for mark, inner in chosen:
            self.run(inner, F.col(mark))

    def _stop(self, guard: Column | None) -> None:
        mark = self.fresh("stopped")
        self.out.rows = self.out.rows.withColumn(mark, F.lit(True) if guard is None else guard)
        self.running = ~F.col(mark) if self.running is None else self.running & ~F.col(mark)

    def _action(self, s: Statement, guard: Column | None) -> None:
        name, args = s.name.lower(), s.arguments
        if name in ("setfield", "setlocalvar", "setreturnvar"):
            target = (args.get("Field") or args.get("Name") or "").split(".")[-1].strip("[]")
            known = {c.lower(): c for c in self.out.rows.columns}
            column = known.get(target.lower(), target)
            value = self.column(args.get("Value") or args.get("Expression") or "Null")
            old = F.col(bracketed(column)) if target.lower() in known else F.lit(None)
            if target.lower() in known:
                value = value.cast(dict(self.out.rows.dtypes)[column])
            self.out.rows = self.out.rows.withColumn(column, value if guard is None else F.when(guard, value).otherwise(old))
            if name == "setreturnvar" and column not in self.columns:
                self.columns.append(column)
        elif name == "raiseerror":
            self._raise(s, guard)
        elif name == "rundatamacro":
            self._run_named(args, guard)
        elif name == "deleterecord":
            self._delete(guard)
        elif name in ("stopmacro", "stopallmacros", "exitforeachrecord"):
            self._stop(guard)
        elif name == "clearmacroerror":
            for c, kind in ((_ERROR, "string"), (_NUMBER, "int")):
                if c in self.out.rows.columns:
                    self.out.rows = self.out.rows.withColumn(c, F.lit(None).cast(kind) if guard is None else F.when(~guard, F.col(c)))
        elif name == "onerror" and (args.get("GoTo") or args.get("Goto") or "").strip().lower() in ("next", "fail"):
            on = F.lit((args.get("GoTo") or args.get("Goto")).strip().lower() == "next")
            old = F.col(_RESUME) if _RESUME in self.out.rows.columns else F.lit(False)
            self.out.rows = self.out.rows.withColumn(_RESUME, on if guard is None else F.when(guard, on).otherwise(old))
        elif name == "onerror":  # goes on in a submacro
            self.out.findings.append(Finding("MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE", s.name))
        else:
            raise CompileError("MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE", s.name)

    def _refuse(self, bad: DataFrame, message: Column) -> None:
        bad = bad.select(*map(bracketed, self.columns), message.alias("error"))
        self.out.errors = bad if self.out.errors is None else self.out.errors.unionByName(bad)

    def _raise(self, s: Statement, guard: Column | None) -> None:
        """Refuses rows; those for which OnError says Next go on, with the error in MacroError."""
        message, number = F.lit(macroloops.message_of(s)), F.lit(int(s.arguments.get("Error Number") or s.arguments.get("Number") or -1))
        if _RESUME in self.out.rows.columns:
            hit = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
            here = self.out.rows.columns
            for c, value, kind in ((_ERROR, message, "string"), (_NUMBER, number, "int")):
                old = F.col(c) if c in here else F.lit(None).cast(kind)
                self.out.rows = self.out.rows.withColumn(c, F.when(hit & F.col(_RESUME), value).otherwise(old))
            guard = hit & ~F.col(_RESUME)
        self._refuse(self._hit(guard), message)
        self._drop(guard)

    def _run_named(self, args: dict[str, str], guard: Column | None) -> None:
        """Runs a named macro over the same rows; its parameters are values of the rows while it runs."""
        name = args.get("MacroName") or ""
        handler = self.named.get(name.casefold())
        if handler is None or self.in_loop:
            raise CompileError("MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE", f"RunDataMacro {name}")
        if self.depth >= NESTED:
            raise CompileError("MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE", f"RunDataMacro {name} runs itself")
        given = {k.partition(":")[2]: self.column(v) for k, v in args.items() if k.startswith("Parameter:")}
        if given:
            self.out.rows = self.out.rows.withColumns(given)
        self.depth += 1
        self.run(handler.statements, guard)
        self.depth -= 1
        self.out.rows = self.out.rows.drop(*[c for c in given if c not in self.columns])

    def _drop(self, guard: Column | None) -> None:
        self.out.rows = self.out.rows.limit(0) if guard is None else self.out.rows.filter(~F.coalesce(guard, F.lit(False)))

    def _delete(self, guard: Column | None) -> None:
        """Deletes the record at hand: the innermost looked-up one, else the firing row."""
        if self.current:
            record = self.current[-1]
            table, gone = record.table, self._records(record, self._hit(guard)).distinct()
        else:
            table, gone = "self", self._hit(guard).select(*self.columns)
            self._drop(guard)
        before = self.out.deleted.get(table)
        gone = gone if before is None else before.unionByName(gone)
        self.out.deleted[table] = gone if table == "self" else gone.distinct()

    def _records(self, record: _Record, rows: DataFrame) -> DataFrame:
        """The looked-up records that rows hold, with the names of their table."""
        there = rows.filter(F.col(bracketed(record.columns[""])).isNotNull())
        return there.select(*[F.col(bracketed(record.columns[c.lower()])).alias(c) for c in self.tables(record.table).columns])

    def _block(self, s: Statement, guard: Column | None) -> None:
        if s.name == "Group":
            self.run(s.statements, guard)
        elif s.name == "CreateRecord":
            self._create(s, guard)
        elif s.name == "EditRecord":
            alias = (s.arguments.get("Alias") or "").lower()
            record = self.looked.get(alias) or (self.current[-1] if self.current else None)
            if record is None:
                self.run(s.statements, guard)
            else:
                self._edit(s, record, guard)
        elif s.name == "LookUpRecord":
            self._look_up(s, guard)
        elif s.name == "ForEachRecord":
            self._for_each(s, guard)
        else:
            raise CompileError("MACRO_ELEMENT_NOT_RECOGNISED", s.name)

    def _source(self, s: Statement) -> tuple[str, _Record, DataFrame, str, list[str]]:
        """(alias, record, its table under the names of its columns here, condition, columns of the rows at hand that it reads)."""
        source = s.arguments.get("Reference") or s.arguments.get("Source") or ""
        alias = (s.arguments.get("Alias") or source).lower()
        other = self.tables(source)
        prefix = self.fresh(alias)
        record = _Record(source, {c.lower(): f"{prefix}_{c}" for c in other.columns} | {"": f"{prefix}_found"})
        renamed = other.select(*[F.col(bracketed(c)).alias(record.columns[c.lower()]) for c in other.columns], F.lit(True).alias(record.columns[""]))
        condition = s.arguments.get("WhereCondition") or s.arguments.get("Where") or "True"
        here = {c.lower(): c for c in self.out.rows.columns}
        used = set()
        for node in walk(parse(condition)):
            if node.path and node.kind != "call":
                owner = node.path[-2].lower() if len(node.path) > 1 else ""
                if owner in self.looked and owner != alias:
                    used.add(self.looked[owner].columns[node.path[-1].lower()])
                elif owner != alias and node.path[-1].lower() in here:
                    used.add(here[node.path[-1].lower()])
        return alias, record, renamed, condition, sorted(used)

    def _matches(self, record: _Record, alias: str, other: DataFrame, condition: str, used: list[str]) -> tuple[DataFrame, list[str]]:
        """(distinct values of `used` with each record that meets the condition, their names there)."""
        rows, keys = self.out.rows, [self.fresh("key") for _ in used]
        self.looked[alias] = record
        typed = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in other.dtypes])
        self.out.rows = typed  # so that the condition sees the record's columns
        test = self.column(condition)
        self.out.rows = rows
        left = rows.select(*map(bracketed, used)).distinct() if used else None
        pairs = other.filter(test) if left is None else left.join(other, test)
        return pairs.select(*[F.col(bracketed(u)).alias(k) for u, k in zip(used, keys, strict=True)], *other.columns), keys

    def _attach(self, pairs: DataFrame, used: list[str], keys: list[str], how: str) -> DataFrame:
        rows = self.out.rows
        on = _all([rows[bracketed(u)].eqNullSafe(pairs[k]) for u, k in zip(used, keys, strict=True)]) if used else F.lit(True)
        return rows.join(pairs, on, how).drop(*keys)

    def _look_up(self, s: Statement, guard: Column | None) -> None:
        """Brings in the columns of the looked-up record, the least match by its columns."""
        alias, record, other, condition, used = self._source(s)
        pairs, keys = self._matches(record, alias, other, condition, used)
        least = F.min(F.struct(*[F.col(bracketed(c)) for c in other.columns])).alias("least")
        first = (pairs.groupBy(*keys) if keys else pairs.groupBy()).agg(least).select(*keys, "least.*")
        self.out.rows = self._attach(first, used, keys, "left")
        self.current.append(record)
        found = F.coalesce(F.col(bracketed(record.columns[""])), F.lit(False))
        inner = [x for x in s.statements if not self._touches_record(x)]
        if len(inner) == len(s.statements):
            self.run(s.statements, guard)
        else:
            for x in s.statements:  # what changes the record needs one
                self.run([x], self._both(guard, found) if self._touches_record(x) else guard)
        self.current.pop()

    @staticmethod
    def _touches_record(s: Statement) -> bool:
        return any(x.name in ("EditRecord", "DeleteRecord") for x in s.walk())

    def _for_each(self, s: Statement, guard: Column | None) -> None:
        """Runs the statements over every match; of the firing rows only what the loop carries changes."""
        alias, record, other, condition, used = self._source(s)
        names = None if self.in_loop else macroloops.carried(s.statements, {c.lower() for c in self.out.rows.columns})
        if names is not None:
            return self._carry(s, names, alias, record, other, condition, used, guard)
        if self.in_loop and macroloops.carried(s.statements, {c.lower() for c in self.out.rows.columns}) is not None:
            raise CompileError("MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE", "a loop in a loop that carries values")
        pairs, keys = self._matches(record, alias, other, condition, used)
        firing, running, outer = self.out.rows, self.running, self.in_loop
        if guard is not None:
            self.out.rows = firing.filter(guard)
        self.out.rows = self._attach(pairs, used, keys, "inner")
        self.running, self.in_loop = None, True
        self.current.append(record)
        leave = self._leaves(s.statements)
        if leave is not None:  # records after the first that leaves the loop, in the order of their columns, are not visited
            mark = self.fresh("left")
            order = Window.partitionBy(*map(bracketed, firing.columns)).orderBy(*map(bracketed, other.columns)).rowsBetween(Window.unboundedPreceding, -1)
            self.out.rows = self.out.rows.withColumn(mark, F.coalesce(F.max(leave.cast("int")).over(order), F.lit(0))).filter(F.col(mark) == 0)
        self.run(s.statements, None)
        self.current.pop()
        self.out.rows, self.running, self.in_loop = firing, running, outer

    def _carry(self, s: Statement, names: set[str], alias: str, record: _Record, other: DataFrame, condition: str, used: list[str], guard: Column | None) -> None:
        """A loop that carries values: sums as aggregates of the matches, else a fold over them."""
        here = {c.lower(): c for c in self.out.rows.columns}
        types = {n: dict(self.out.rows.dtypes)[here[n]] for n in names}
        parts = macroloops.sums(s.statements, names)
        if parts is not None:
            read = {n.path[-1].lower() for _, _, term, conditions in parts for t in (term, *(parse(x) for before, own in conditions for x in (*before, own) if x)) for n in walk(t) if n.kind == "name"}
            used = sorted({*used, *(here[c] for c in read & set(here))})
        pairs, keys = self._matches(record, alias, other, condition, used)
        made = pairs.groupBy(*keys) if keys else pairs.groupBy()
        live = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
        if parts is not None:
            own = {u.lower(): k for u, k in zip(used, keys, strict=True)}
            outer = self.context()
            inside = Context(lambda path: F.col(bracketed(own[path[-1].lower()])) if len(path) == 1 and path[-1].lower() in own else outer.resolve(path), kind=outer.kind)
            totals, odd, aggregates = {}, {}, []
            for i, (_, sign, term, conditions) in enumerate(parts):
                taken = macroloops.condition_column(conditions, lambda text: Compiler(inside).column(parse(text)))
                value = Compiler(inside).column(term)
                totals[i], odd[i] = self.fresh("sum"), self.fresh("null")
                aggregates += [F.sum(F.when(taken, value if sign == "+" else -value)).alias(totals[i]), F.coalesce(F.bool_or(taken & value.isNull()), F.lit(False)).alias(odd[i])]
            self.out.rows = self._attach(made.agg(*aggregates), used, keys, "left")
            for n in names:
                mine = [i for i, part in enumerate(parts) if part[0] == n]
                value = F.col(bracketed(here[n]))
                bad = F.lit(False)
                for i in mine:
                    value = value + F.coalesce(F.col(totals[i]), F.lit(0))
                    bad = bad | F.coalesce(F.col(odd[i]), F.lit(False))
                self.out.rows = self.out.rows.withColumn(here[n], F.when(live & bad, F.lit(None)).when(live, value.cast(types[n])).otherwise(F.col(bracketed(here[n]))))
            self.out.rows = self.out.rows.drop(*totals.values(), *odd.values())
            return
        items, fold = self.fresh("items"), self.fresh("fold")
        listed = made.agg(F.sort_array(F.collect_list(F.struct(*[F.col(bracketed(c)) for c in other.columns]))).alias(items))
        self.out.rows = self._attach(listed, used, keys, "left")
        fields = {c: name for c, name in record.columns.items() if c}
        loop = macroloops.Fold(s.statements, {n: here[n] for n in names}, types, alias, fields, self.context())
        self.out.rows = self.out.rows.withColumn(fold, F.when(live & F.col(items).isNotNull(), loop.column(F.col(items)))).drop(items)
        state = F.col(fold)
        for n in names:
            self.out.rows = self.out.rows.withColumn(here[n], F.when(state.isNotNull(), state[f"v_{n}"]).otherwise(F.col(bracketed(here[n]))))
        body = {x.name.lower() for x in s.walk() if x.kind == "action"}
        if "raiseerror" in body:
            self._refuse(self.out.rows.filter(state["error"].isNotNull()), state["error"])
            self._drop(state["error"].isNotNull())
        if body & {"stopmacro", "stopallmacros"}:
            self._stop(F.coalesce(state["halt"] == 2, F.lit(False)))

    def _leaves(self, statements: list[Statement]) -> Column | None:
        """Whether a record of a loop leaves it: by ExitForEachRecord in the loop's body or its branches."""
        out: Column | None = None
        for s in statements:
            found = None
            if s.kind == "action" and s.name.lower() == "exitforeachrecord":
                found = F.lit(True)
            elif s.kind == "conditional":
                rest = F.lit(True)
                for name, condition, inner in s.branches:
                    test = F.coalesce(self.column(condition), F.lit(False)) if name != "else" and condition else F.lit(True)
                    leaves = self._leaves(inner)
                    if leaves is not None:
                        found = rest & test & leaves if found is None else found | (rest & test & leaves)
                    rest = rest & ~test
            if found is not None:
                out = found if out is None else out | found
        return out

    def _edit(self, s: Statement, record: _Record, guard: Column | None) -> None:
        """Changes a looked-up record in its table; of several edits of one record the least stays."""
        table = self.tables(record.table)
        types = {c.lower(): (c, t) for c, t in table.dtypes}
        values: dict[str, Column] = {}
        for inner in s.statements:
            if inner.kind == "comment":
                continue
            if inner.kind != "action" or inner.name.lower() != "setfield":
                raise CompileError("MACRO_ACTION_UNKNOWN_NOT_TRANSLATABLE", f"{inner.name or inner.kind} in EditRecord")
            column, kind = types[(inner.arguments.get("Field") or "").split(".")[-1].strip("[]").lower()]
            values[column] = self.column(inner.arguments.get("Value") or "Null").cast(kind)
        rows = self._hit(guard).filter(F.col(bracketed(record.columns[""])).isNotNull())
        keys = [F.col(bracketed(record.columns[c.lower()])).alias(f"old_{i}") for i, c in enumerate(table.columns)]
        made = rows.groupBy(*keys).agg(F.min(F.struct(*[v.alias(c) for c, v in values.items()])).alias("changed"))
        self.edits.setdefault(record.table, []).append((made, list(values)))

    def edited(self) -> dict[str, DataFrame]:
        """Each table that EditRecord changed, as it is afterwards."""
        out = {}
        for name, edits in self.edits.items():
            base = self.tables(name)
            now = base.select(*[F.col(bracketed(c)).alias(f"was_{i}") for i, c in enumerate(base.columns)], *map(bracketed, base.columns))
            for made, changed in edits:
                on = _all([now[f"was_{i}"].eqNullSafe(made[f"old_{i}"]) for i in range(len(base.columns))])
                new = {c: F.when(F.col("changed").isNotNull(), F.col(f"changed.{bracketed(c)}")).otherwise(F.col(bracketed(c))) for c in changed}
                now = now.join(made, on, "left").withColumns(new).select(*now.columns)
            out[name] = now.select(*map(bracketed, base.columns))
        return out

    def _create(self, s: Statement, guard: Column | None) -> None:
        target = s.arguments.get("Reference") or s.arguments.get("In") or ""
        types = dict(self.tables(target).dtypes)
        values = {}
        for inner in s.statements:
            if inner.kind == "action" and inner.name.lower() == "setfield":
                column = (inner.arguments.get("Field") or "").split(".")[-1].strip("[]")
                values[column.lower()] = self.column(inner.arguments.get("Value") or "Null")
        rows = self._hit(guard)
        made = rows.select(*[(values.get(c.lower(), F.lit(None))).cast(t).alias(c) for c, t in types.items()])
        before = self.out.created.get(target)
        self.out.created[target] = made if before is None else before.unionByName(made)


def run_handler(handler: Handler, rows: DataFrame, tables: Tables, is_insert: bool = True, named: dict[str, Handler] | None = None) -> Outcome:
    """Runs a data-macro handler over the rows that fire it. Temporary columns are gone afterwards.

    A looked-up record is the least match by its columns in their order, so the
    result does not depend on the order of rows. StopMacro, StopAllMacros and
    ExitForEachRecord stop the rows (or records of a loop) for which they are reached.
    A loop goes through its matches in the order of their columns, and what it sets of the
    values known before it is carried on. `named` has the macros that RunDataMacro runs, by name.
    """
    runner = _Runner(rows, tables, is_insert, named)
    runner.run(handler.statements, None)
    runner.out.edited = runner.edited()
    runner.out.rows = runner.out.rows.select(*[bracketed(c) for c in runner.columns])
    return runner.out
