"""Stored SQL taken apart into clauses, so that saved SELECT text becomes a query model.

Only what stands at depth 0, outside literals, brackets and parentheses, parts clauses;
the expressions in them keep their text and are read by the expression grammar.
"""

from __future__ import annotations

import re

from gridspark.functions.columns import CompileError
from gridspark.functions.grammar import parse, walk

from .model import Join, Ordering, OutputColumn, QueryModel, Source

_PIECE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|#[^#\n]*#|\[[^\]]*\]|[^\W\d]\w*\$?|\d[\w.]*|.", re.S)
Word = tuple[str, int, int]


def words(text: str) -> list[Word]:
    """(word in lower case, start, end) of names, commas and semicolons at depth 0."""
    out, depth = [], 0
    for m in _PIECE.finditer(text):
        piece = m[0]
        depth += (piece == "(") - (piece == ")")
        if depth == 0 and (piece in ",;" or re.match(r"[^\W\d]", piece)):
            out.append((piece.lower(), m.start(), m.end()))
    return out


def fail(what: str) -> CompileError:
    return CompileError("STORED_SQL_NOT_RE_PARSED", what)


def split_commas(text: str) -> list[str]:
    cuts = [a for w, a, _ in words(text) if w == ","]
    return [text[a:b].strip() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]


def bare(name: str) -> str:
    return name.strip().strip("[]")


def without_parameters(sql: str) -> str:
    """The statement behind a PARAMETERS clause; its names are looked up as any prompt is."""
    text = sql.strip().rstrip(";").strip()
    found = words(text)
    if found and found[0][0] == "parameters":
        end = next((b for w, _, b in found if w == ";"), None)
        if end is None:
            raise fail("parameters")
        text = text[end:].strip()
    return text


def clauses(text: str, *names: str) -> dict[str, str]:
    """The text behind each of the clause names (of one or two words) that are there, in any order."""
    found, w = [], words(text)
    for i, (word, a, b) in enumerate(w):
        two = f"{word} {w[i + 1][0]}" if i + 1 < len(w) else ""
        if two in names:
            found.append((two, a, w[i + 1][2]))
        elif word in names:
            found.append((word, a, b))
    ends = [*(a for _, a, _ in found[1:]), len(text)][: len(found)]
    return {name: text[b:end].strip() for (name, _, b), end in zip(found, ends, strict=True)}


def unions(text: str) -> list[tuple[str, bool]]:
    """(SELECT text, whether it is joined to those before by UNION ALL)."""
    out, at, keep = [], 0, False
    w = words(text)
    for i, (word, a, b) in enumerate(w):
        if word == "union":
            out.append((text[at:a].strip(), keep))
            keep = i + 1 < len(w) and w[i + 1][0] == "all"
            at = w[i + 1][2] if keep else b
    return [*out, (text[at:].strip(), keep)]


def _unwrap(text: str) -> str:
    text = text.strip()
    while text.startswith("(") and not words(text) and text.endswith(")"):
        text = text[1:-1].strip()
    return text


def read_from(text: str, model: QueryModel, subqueries: dict[str, str]) -> list[str]:
    """Adds the tables and joins of a FROM clause to a model; the keys of its tables.

    A table may be a SELECT in parentheses with an alias: it goes to `subqueries`.
    """
    parts = split_commas(text)
    if len(parts) > 1:
        return [key for p in parts for key in read_from(p, model, subqueries)]
    whole = _unwrap(text)
    w = words(whole)
    joins = [i for i, (word, _, _) in enumerate(w) if word == "join"]
    if joins:
        last = joins[-1]
        kind = w[last - 1][0] if last and w[last - 1][0] in ("inner", "left", "right") else w[last - 2][0] if last > 1 and w[last - 1][0] == "outer" else "inner"
        begin = last - 1 if w[last - 1][0] == kind else last - 2 if w[last - 1][0] == "outer" else last
        on = next((x for x in w[last:] if x[0] == "on"), None)
        if on is None or kind not in ("inner", "left", "right"):
            raise fail("join")
        left = read_from(whole[: w[begin][1]], model, subqueries)
        right = read_from(whole[w[last][2] : on[1]], model, subqueries)
        if kind != "inner" and len(right) > 1:
            raise fail("outer join of a group")
        condition = _unwrap(whole[on[2] :])
        named = [n.path[-2].casefold() for n in walk(parse(condition)) if len(n.path) > 1]
        pick = lambda keys: next((k for k in keys if k.casefold() in named), keys[-1])
        model.joins.append(Join(pick(left), pick(right), condition, {"inner": "1", "left": "2", "right": "3"}[kind]))
        return left + right
    m = re.fullmatch(r"(\(.*\)|\[[^\]]+\]|[^\W\d][\w$]*)(?:\s+(?:AS\s+)?(\[[^\]]+\]|[^\W\d]\w*))?", text.strip(), re.I | re.S)
    if not m:
        raise fail(f"table {text.strip()[:40]}")
    alias = bare(m[2]) if m[2] else None
    if m[1].startswith("("):
        name = alias or f"subquery_{len(subqueries)}"
        subqueries[name] = _unwrap(m[1])
    else:
        name = bare(m[1])
    model.sources.append(Source(name, alias if alias != name else None))
    return [alias or name]


def read_select(sql: str) -> tuple[QueryModel, dict[str, str]]:
    """(model, SELECT text by name of table) of one SELECT without UNION; INTO is left out."""
    text = sql.strip()
    m = re.match(r"SELECT\s+(?:ALL\s+)?(DISTINCT(?:ROW)?\s+)?(?:TOP\s+(\d+(?:\.\d+)?)\s+(PERCENT\s+)?)?", text, re.I)
    if not m or re.match(r"TOP\b", text[m.end() :], re.I):
        raise fail("select")
    body = clauses(text[m.end() :], "into", "from", "where", "group by", "having", "order by")
    first = next((a for w, a, _ in words(text[m.end() :]) if w in ("into", "from")), len(text) - m.end())
    if "from" not in body:
        raise fail("no table")
    model, subqueries = QueryModel("stored", distinct=bool(m[1]), top=f"{m[2]}%" if m[3] else m[2]), {}
    read_from(body["from"], model, subqueries)
    for item in split_commas(text[m.end() : m.end() + first]):
        named = [(a, b) for w, a, b in words(item) if w == "as"]
        model.columns.append(OutputColumn(item[: named[-1][0]].strip(), bare(item[named[-1][1] :])) if named else OutputColumn(item.strip()))
    if [c.expression for c in model.columns] == ["*"]:
        model.columns = []
    model.where, model.having = body.get("where"), body.get("having")
    model.groups = [OutputColumn(g) for g in split_commas(body["group by"])] if "group by" in body else []
    for item in split_commas(body["order by"]) if "order by" in body else []:
        d = re.search(r"\s+(ASC|DESC)$", item, re.I)
        model.ordering.append(Ordering(item[: d.start()] if d else item, bool(d) and d[1].lower() == "desc"))
    return model, subqueries
