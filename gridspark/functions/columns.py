"""Expressions as Spark columns, compiled from the tree."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import Node, parse
from .neutral import like_pattern, ui_parameter
from .registry import AGGREGATES, UI_ROOTS, support_of


class CompileError(ValueError):
    """An expression without a Spark form; `code` is its reason code."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


#: Functions that users add: name to a builder of a column from columns.
_user: dict[str, Callable[..., Column]] = {}


def register_function(name: str, build: Callable[..., Column]) -> None:
    """Makes a ported user function callable in expressions, as a column builder (a UDF is one)."""
    _user[name.lower()] = build


@dataclass
class Context:
    """Where names come from.

    `resolve`: path of a name to a column, or None. `params`: values of form
    references and prompts. `kind`: Spark type name of a column expression, for
    Nz with one argument. `order`: the column by which First and Last choose.
    `null_concat`: "sql" (null if a side is null) or "access" (null is empty).
    """

    resolve: Callable[[tuple[str, ...]], Column | None]
    params: dict[str, object] = field(default_factory=dict)
    kind: Callable[[tuple[str, ...]], str | None] = lambda path: None
    order: Column | None = None
    null_concat: str = "sql"
    case_sensitive_like: bool = True
    replaced: dict[Node, Column] = field(default_factory=dict)


_DATE = re.compile(r"(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})/(\d{1,2})/(\d{4}))(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?)?")


def date_literal(text: str) -> dt.datetime:
    """#m/d/yyyy [h:n[:s] [AM|PM]]# or #yyyy-m-d ...#."""
    m = _DATE.fullmatch(text.strip())
    if not m:
        raise CompileError("EXPRESSION_NODE_NOT_TRANSLATED", f"date {text}")
    g = m.groups()
    year, month, day = (g[0], g[1], g[2]) if g[0] else (g[5], g[3], g[4])
    hour = int(g[6] or 0)
    if g[9]:
        hour = hour % 12 + (12 if g[9].lower() == "pm" else 0)
    return dt.datetime(int(year), int(month), int(day), hour, int(g[7] or 0), int(g[8] or 0))


def _text(c: Column) -> Column:
    return c.cast("string")


def _when(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def _truncate(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def _whole(c: Column) -> Column:
    """A number as \\ and Mod take it: rounded half to even."""
    return F.bround(c, F.lit(0)).cast("long")


#: Interval codes of DatePart, DateAdd and DateDiff.
_PARTS: dict[str, Callable[[Column], Column]] = {
    "yyyy": F.year, "q": F.quarter, "m": F.month, "y": F.dayofyear, "d": F.dayofmonth, "w": F.dayofweek, "ww": F.weekofyear, "h": F.hour, "n": F.minute, "s": F.second,
}


def _months(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def _seconds(c: Column, unit: str) -> Column:
    return F.unix_timestamp(F.date_trunc(unit, c))


def date_diff(code: str, a: Column, b: Column) -> Column:
    """Boundaries of the interval between two dates, as VBA counts them (weeks start on Sunday)."""
    sunday = lambda c: F.date_sub(F.to_date(c), F.dayofweek(c) - 1)
    made = {
        "yyyy": lambda: F.year(b) - F.year(a),
        "q": lambda: (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a)),
        "m": lambda: _months(b) - _months(a),
        "y": lambda: F.datediff(b, a),
        "d": lambda: F.datediff(b, a),
        "w": lambda: _truncate(F.datediff(b, a) / 7),
        "ww": lambda: F.datediff(sunday(b), sunday(a)) / 7,
        "h": lambda: (_seconds(b, "hour") - _seconds(a, "hour")) / 3600,
        "n": lambda: (_seconds(b, "minute") - _seconds(a, "minute")) / 60,
        "s": lambda: _seconds(b, "second") - _seconds(a, "second"),
    }
    if code not in made:
        raise CompileError("ACCESS_RUNTIME_FUNCTION", f"datediff {code}")
    return made[code]().cast("int")


def date_add(code: str, n: Column, d: Column) -> Column:
    """Whole intervals added in local time, so that no change of the clock shifts the hour."""
    n, local = n.cast("int"), d.cast("timestamp_ntz")
    months = {"yyyy": 12, "q": 3, "m": 1}
    if code in months:
        day = F.to_date(local)
        return (F.add_months(day, n * months[code]).cast("timestamp_ntz") + (local - day.cast("timestamp_ntz"))).cast("timestamp")
    none = F.lit(0)
    made = {
        "y": lambda: F.make_dt_interval(n), "d": lambda: F.make_dt_interval(n), "w": lambda: F.make_dt_interval(n), "ww": lambda: F.make_dt_interval(n * 7),
        "h": lambda: F.make_dt_interval(none, n), "n": lambda: F.make_dt_interval(none, none, n), "s": lambda: F.make_dt_interval(none, none, none, n),
    }
    if code not in made:
        raise CompileError("ACCESS_RUNTIME_FUNCTION", f"dateadd {code}")
    return (local + made[code]()).cast("timestamp")


#: Pieces of date pictures.
_PICTURE = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "hh": "HH", "h": "H", "nn": "mm", "n": "m", "ss": "ss", "s": "s"}


def format_value(c: Column, picture: str, kind: str | None) -> Column:
    """A subset of Format: date pictures, and 0, 0.00, #,##0.00 and percentages for numbers."""
    m = re.fullmatch(r"(#,##)?0(?:\.(0+))?(%?)", picture)
    if m:
        places = len(m[2] or "")
        scaled = c.cast("double") * (100 if m[3] else 1)
        number = F.format_number(scaled, places)
        return F.concat(number if m[1] else F.regexp_replace(number, ",", ""), F.lit(m[3]))
    named = {"general number": "0", "standard": "#,##0.00", "fixed": "0.00", "percent": "0.00%"}
    if picture.lower() in named:
        return format_value(c, named[picture.lower()], kind)
    parts = re.findall(r"y+|m+|d+|h+|n+|s+|[^ymdhns]+", picture.lower())
    if not all(p in _PICTURE or re.fullmatch(r"[^a-z']+", p) for p in parts):
        raise CompileError("ACCESS_RUNTIME_FUNCTION", f"format {picture}")
    return F.date_format(c, "".join(_PICTURE.get(p, p) for p in parts))


_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _val(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_text(c), _NUMBER, 1), F.lit("")).try_cast("double"), F.lit(0.0))


def _partition(n: Column, start: Column, stop: Column, step: Column) -> Column:
    """Partition(): the bucket "low:high" of a number, blanks before and after the whole range."""
    low = start + F.floor((n - start) / step) * step
    width = F.length(_text(stop + 1))
    pad = lambda c: F.lpad(_text(c), width.cast("int") if isinstance(width, Column) else width, " ")
    inside = F.concat(pad(low.cast("long")), F.lit(":"), pad(F.least(low + step - 1, stop).cast("long")))
    under = F.concat(F.lpad(F.lit(""), width, " "), F.lit(":"), pad(start - 1))
    over = F.concat(pad(stop + 1), F.lit(":"), F.lpad(F.lit(""), width, " "))
    return F.when(n < start, under).when(n > stop, over).otherwise(inside)


def _serial(y: Column, m: Column, d: Column) -> Column:
    return F.date_add(F.add_months(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), m.cast("int") - 1), d.cast("int") - 1)


def _clock(seconds: Column) -> Column:
    s = F.pmod(seconds.cast("long"), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


_SIMPLE: dict[tuple[str, int], Callable[..., Column]] = {
    ("abs", 1): F.abs,
    ("sgn", 1): lambda x: F.signum(x).cast("int"),
    ("sqr", 1): F.sqrt,
    ("exp", 1): F.exp,
    ("log", 1): F.ln,
    ("int", 1): F.floor,
    ("fix", 1): _truncate,
    ("round", 1): lambda x: F.round(x, 0),
    ("len", 1): lambda x: F.char_length(_text(x)),
    ("ucase", 1): F.upper,
    ("lcase", 1): F.lower,
    ("trim", 1): F.trim,
    ("ltrim", 1): F.ltrim,
    ("rtrim", 1): F.rtrim,
    ("left", 2): lambda s, n: F.left(_text(s), n.cast("int")),
    ("right", 2): lambda s, n: F.right(_text(s), n.cast("int")),
    ("mid", 2): lambda s, p: F.substring(_text(s), p.cast("int"), F.char_length(_text(s))),
    ("mid", 3): lambda s, p, n: F.substring(_text(s), p.cast("int"), n.cast("int")),
    ("instr", 2): lambda s, t: F.call_function("locate", t, s),
    ("instr", 3): lambda at, s, t: F.call_function("locate", t, s, at.cast("int")),
    ("replace", 3): F.replace,
    ("string", 2): lambda n, c: F.repeat(F.left(_text(c), F.lit(1)), n.cast("int")),
    ("space", 1): lambda n: F.repeat(F.lit(" "), n.cast("int")),
    ("asc", 1): F.ascii,
    ("chr", 1): lambda n: F.chr(n.cast("long")),
    ("nz", 2): F.coalesce,
    ("iif", 2): lambda c, a: F.when(c, a),
    ("iif", 3): lambda c, a, b: F.when(c, a).otherwise(b),
    ("isnull", 1): lambda x: x.isNull(),
    ("isempty", 1): lambda x: x.isNull(),
    ("isnumeric", 1): lambda x: _text(x).try_cast("double").isNotNull(),
    ("isdate", 1): lambda x: _text(x).try_cast("timestamp").isNotNull(),
    ("date", 0): F.current_date,
    ("now", 0): F.current_timestamp,
    ("time", 0): lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"),
    ("year", 1): F.year,
    ("month", 1): F.month,
    ("day", 1): F.dayofmonth,
    ("hour", 1): F.hour,
    ("minute", 1): F.minute,
    ("second", 1): F.second,
    ("weekday", 1): F.dayofweek,
    ("dateserial", 3): _serial,
    ("timeserial", 3): lambda h, n, s: _clock(h * 3600 + n * 60 + s),
    ("datevalue", 1): lambda x: _text(x).try_cast("date"),
    ("timevalue", 1): lambda x: F.date_format(x.cast("timestamp"), "HH:mm:ss"),
    ("cint", 1): lambda x: F.bround(x.try_cast("double"), 0).try_cast("int"),
    ("clng", 1): lambda x: F.bround(x.try_cast("double"), 0).try_cast("int"),
    ("cbyte", 1): lambda x: F.bround(x.try_cast("double"), 0).try_cast("int"),
    ("cdbl", 1): lambda x: x.try_cast("double"),
    ("csng", 1): lambda x: x.try_cast("float"),
    ("ccur", 1): lambda x: x.try_cast("decimal(19,4)"),
    ("cdec", 1): lambda x: x.try_cast("decimal(28,10)"),
    ("cstr", 1): _text,
    ("str", 1): _text,
    ("cdate", 1): lambda x: x.try_cast("timestamp"),
    ("cbool", 1): lambda x: x.cast("boolean"),
    ("cvar", 1): lambda x: x,
    ("val", 1): _val,
    ("partition", 4): _partition,
}

CONVERSIONS = frozenset("cint clng cbyte cdbl csng ccur cdec cdate datevalue timevalue".split())

_AGGREGATE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def aggregate(name: str, x: Column, order: Column | None = None) -> Column:
    """An aggregate by its name here; First and Last choose by `order` where it is given."""
    if name in ("first", "last"):
        if order is None:
            return F.first(x) if name == "first" else F.last(x)
        return F.min_by(x, order) if name == "first" else F.max_by(x, order)
    return _AGGREGATE[name](x)


#: A part of a Like pattern: a class of characters, or one character.
_LIKE_PART = r"\[!?[^\]]+\]|[\s\S]"
#: Characters that mean something inside a class of a regular expression, and outside of one.
_IN_CLASS, _IN_REGEX = r"[\\\[\^&]", r"[\\^$.|?*+(){}\[\]]"


def like_regex(pattern: str, case_sensitive: bool = True) -> str:
    """A Like pattern as a regular expression: *, ?, #, [abc], [a-c] and [!a-c]; a bracket without an end is itself."""

    def part(p: str) -> str:
        if len(p) > 1:
            return f"[{'^' if p[1] == '!' and len(p) > 3 else ''}{re.sub(_IN_CLASS, lambda m: chr(92) + m[0], p[2:-1] if p[1] == '!' and len(p) > 3 else p[1:-1])}]"
        return {"*": ".*", "?": ".", "#": "[0-9]"}.get(p) or re.sub(_IN_REGEX, lambda m: chr(92) + m[0], p)

    return ("(?s)" if case_sensitive else "(?isu)") + "\\A" + "".join(map(part, re.findall(_LIKE_PART, pattern))) + "\\z"


def _like_regex(pattern: Column, case_sensitive: bool) -> Column:
    """`like_regex` of a column of patterns."""
    escaped = lambda c, which: F.regexp_replace(c, which, r"\\$0")

    def part(p: Column) -> Column:
        negated = (F.substring(p, 2, 1) == "!") & (F.length(p) > 3)
        inner = F.when(negated, F.substring(p, F.lit(3), F.length(p) - 3)).otherwise(F.substring(p, F.lit(2), F.length(p) - 2))
        return F.when(F.length(p) > 1, F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), escaped(inner, _IN_CLASS), F.lit("]"))).when(p == "*", ".*").when(p == "?", ".").when(p == "#", "[0-9]").otherwise(escaped(p, _IN_REGEX))

    parts = F.transform(F.regexp_extract_all(pattern.cast("string"), F.lit(f"({_LIKE_PART})"), F.lit(1)), part)
    return F.concat(F.lit(("(?s)" if case_sensitive else "(?isu)") + "\\A"), F.array_join(parts, ""), F.lit("\\z"))


class Compiler:
    def __init__(self, context: Context):
        self.context = context

    def column(self, n: Node) -> Column:
        if n in self.context.replaced:
            return self.context.replaced[n]
        return getattr(self, f"_{n.kind}")(n)

    def _string(self, n: Node) -> Column:
        return F.lit(n.value)

    def _number(self, n: Node) -> Column:
        return F.lit(int(n.value)) if n.value.isdigit() else F.lit(float(n.value))

    def _date(self, n: Node) -> Column:
        return F.lit(date_literal(n.value))

    def _bool(self, n: Node) -> Column:
        return F.lit(n.value == "true")

    def _null(self, n: Node) -> Column:
        return F.lit(None)

    def _group(self, n: Node) -> Column:
        return self.column(n.children[0])

    def _star(self, n: Node) -> Column:
        return F.col(".".join(p if p == "*" else f"`{p}`" for p in n.path))

    def _name(self, n: Node) -> Column:
        found = self.context.resolve(n.path)
        if found is not None:
            return found
        name = ui_parameter(n.path) if len(n.path) > 1 and n.path[0].lower() in UI_ROOTS else ".".join(n.path)
        for key, value in self.context.params.items():
            if key.lower() == name.lower():
                return F.lit(value)
        if n.path[0].lower() in UI_ROOTS:
            raise CompileError("UI_REFERENCE_BECOMES_PARAMETER", f"no value for {name}")
        raise CompileError("EXPRESSION_NODE_NOT_TRANSLATED", f"no column or parameter {name}")

    _member = _name

    def _unary(self, n: Node) -> Column:
        inner = self.column(n.children[0])
        return ~inner if n.value == "not" else -inner if n.value == "-" else inner

    def _isnull(self, n: Node) -> Column:
        inner = self.column(n.children[0])
        return inner.isNotNull() if n.negated else inner.isNull()

    def _between(self, n: Node) -> Column:
        made = self.column(n.children[0]).between(self.column(n.children[1]), self.column(n.children[2]))
        return ~made if n.negated else made

    def _in(self, n: Node) -> Column:
        value, *items = map(self.column, n.children)
        made = value.isin(*items) if items else F.lit(False)
        return ~made if n.negated else made

    def _like(self, n: Node) -> Column:
        value, pattern = self.column(n.children[0]), n.children[1]
        strict = self.context.case_sensitive_like
        if pattern.kind == "string" and not re.search(r"[#\[]", pattern.value):
            text = like_pattern(pattern.value.replace("\\", "\\\\"))
            made = value.like(text) if strict else value.ilike(text)
        else:
            made = F.call_function("rlike", value.cast("string"), F.lit(like_regex(pattern.value, strict)) if pattern.kind == "string" else _like_regex(self.column(pattern), strict))
        return ~made if n.negated else made

    def _binary(self, n: Node) -> Column:
        a, b = map(self.column, n.children)
        op = n.value
        if op == "&":
            sides = [_text(a), _text(b)]
            return F.concat(*[F.coalesce(s, F.lit("")) for s in sides] if self.context.null_concat == "access" else sides)
        if op == "\\":
            return F.call_function("div", _whole(a), F.nullif(_whole(b), F.lit(0).cast("long")))
        if op == "/":
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "mod":
            return F.try_mod(_whole(a), _whole(b))
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b), "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b,
            "<=": lambda: a <= b, ">=": lambda: a >= b, "and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a != b, "eqv": lambda: a == b, "imp": lambda: ~a | b,
        }[op]()

    def _subquery(self, n: Node) -> Column:
        raise CompileError("STORED_SQL_NOT_RE_PARSED", "a SELECT where none can be joined")

    _in_query = _exists = _quantified = _subquery

    def _fails(self, n: Node) -> Column:
        """Whether an expression has an error, which is null here: a division by zero, a conversion of what it can't
        convert, a root or logarithm of what has none; in itself or in any operand, as all are evaluated."""
        own = [F.lit(False)]
        name = n.path[-1].lower().rstrip("$") if n.kind == "call" else ""
        if n.kind == "binary" and n.value in ("/", "\\", "mod"):
            divisor = self.column(n.children[1])
            own.append((divisor if n.value == "/" else _whole(divisor)) == 0)
        elif name in CONVERSIONS and len(n.children) == 1:
            own.append(self.column(n.children[0]).isNotNull() & self.column(n).isNull())
        elif name in ("sqr", "log") and len(n.children) == 1:
            x = self.column(n.children[0])
            own.append(x < 0 if name == "sqr" else x <= 0)
        own += [self._fails(c) for c in n.children if name not in ("isnull", "iserror")]
        out = F.lit(False)
        for x in own:
            out = out | F.coalesce(x, F.lit(False))
        return out

    def _literal(self, n: Node, what: str) -> str:
        if n.kind != "string":
            raise CompileError("ACCESS_RUNTIME_FUNCTION", f"{what} needs a literal")
        return n.value

    def _call(self, n: Node) -> Column:
        name, args = n.path[-1].lower().rstrip("$"), n.children
        if name in _user:
            return _user[name](*map(self.column, args))
        if len(n.path) > 1:
            raise CompileError("OBJECT_METHOD_CALL", ".".join(n.path))
        if name in AGGREGATES and len(args) == 1:
            if name == "count" and args[0].kind == "star":
                return F.count(F.lit(1))
            return aggregate(name, self.column(args[0]), self.context.order)
        if name == "round" and len(args) == 2 and args[1].kind == "number":
            return F.round(self.column(args[0]), int(args[1].value))
        if name == "nz" and len(args) == 1:
            kind = self.context.kind(args[0].path) if args[0].path else None
            return F.coalesce(self.column(args[0]), F.lit("") if kind in ("string", None) else F.lit(0))
        if name == "switch" and args and len(args) % 2 == 0:
            made = list(map(self.column, args))
            return _when(list(zip(made[::2], made[1::2], strict=True)))
        if name == "choose" and len(args) > 1:
            at, *values = map(self.column, args)
            return _when([(at == i, v) for i, v in enumerate(values, 1)])
        if name in ("datepart", "dateadd", "datediff"):
            code = self._literal(args[0], name).lower()
            rest = [self.column(a) for a in args[1:]]
            if name == "datepart" and code in _PARTS:
                return _PARTS[code](rest[0])
            if name == "dateadd":
                return date_add(code, *rest)
            if name == "datediff":
                return date_diff(code, *rest[:2])
        if name == "format" and len(args) == 2:
            return format_value(self.column(args[0]), self._literal(args[1], name), None)
        if name == "rnd":
            return F.rand(int(args[0].value) if args and args[0].kind == "number" else 0)
        if name == "iserror" and len(args) == 1:
            return self._fails(args[0])
        if name in ("isarray", "isobject") and len(args) == 1:
            kind = (self.context.kind(args[0].path) if args[0].path else None) or ""
            return self.column(args[0]).isNotNull() & F.lit(kind.startswith("array" if name == "isarray" else ("struct", "map")))
        build = _SIMPLE.get((name, len(args)))
        if build is None:
            kind = support_of(name)
            raise CompileError("UNKNOWN_FUNCTION" if kind is None else "ACCESS_RUNTIME_FUNCTION" if kind == "runtime" else "FUNCTION_REWRITE_INCOMPLETE", f"{name}/{len(args)}")
        return build(*map(self.column, args))


def compile_expression(source: str | Node, context: Context) -> Column:
    """The column of an expression; CompileError (or ParseError) for one that has none."""
    node = parse(source) if isinstance(source, str) else source
    if node is None:
        raise CompileError("EXPRESSION_PARSE_FAILED", "blank")
    return Compiler(context).column(node)


def frame_context(columns: dict[str, str], params: dict[str, object] | None = None, **options) -> Context:
    """A context over one frame: `columns` is name to type name (as in DataFrame.dtypes)."""
    by_name = {c.lower(): (c, t) for c, t in columns.items()}
    resolve = lambda path: F.col(f"`{by_name[path[-1].lower()][0]}`") if path[-1].lower() in by_name else None
    return Context(resolve, params or {}, lambda path: by_name.get(path[-1].lower(), (None, None))[1] if path else None, **options)
