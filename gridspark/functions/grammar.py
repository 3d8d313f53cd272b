"""The expression language of desktop-database definitions: tokens, tree, parser.

Precedence, from loose to tight: Imp, Eqv, Xor, Or, And, Not, comparison (with
Like, In, Between, Is and their negations), &, + and -, Mod, \\, * and /, unary
minus, ^, member access. All binary operators group to the left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')
    | (?P<date>\#[^\#]*\#)
    | (?P<quoted>\[[^\]]*\])
    | (?P<name>[^\W\d]\w*\$?)
    | (?P<op><>|<=|>=|=<|=>|[-+*/\\^&=<>(),.!;])
    )""",
    re.X,
)
WORDS = frozenset({"and", "or", "not", "xor", "eqv", "imp", "like", "in", "between", "is", "null", "true", "false", "mod"})
LEVELS = {"imp": 1, "eqv": 2, "xor": 3, "or": 4, "and": 5, "not": 6, "compare": 7, "&": 8, "+": 9, "-": 9, "mod": 10, "\\": 11, "*": 12, "/": 12, "unary": 13, "^": 14}
#: Kinds of nodes that hold the text of a SELECT.
SUBQUERIES = frozenset({"subquery", "in_query", "exists", "quantified"})
COMPARISONS = frozenset({"=", "<>", "<", ">", "<=", ">="})


class ParseError(ValueError):
    """Text that is no expression."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass(frozen=True)
class Node:
    """kind: string, number, date, bool, null, name, star, member, call, unary, binary,
    between, in, isnull, like, group, or one of SUBQUERIES (whose value is the SELECT's
    text); value: its text; children: its operands."""

    kind: str
    value: str = ""
    children: tuple[Node, ...] = ()
    negated: bool = False
    path: tuple[str, ...] = field(default=())


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ParseError(f"unexpected text at {at}: {text[at : at + 12]!r}")
        kind = m.lastgroup
        word = m.group(kind)
        if kind == "name" and word.lower() in WORDS:
            kind, word = "word", word.lower()
        if kind == "op":
            word = {"=<": "<=", "=>": ">="}.get(word, word)
        out.append(Token(kind, word, m.start(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.items, self.at = text, tokens(text), 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        t = self.items[i] if i < len(self.items) else None
        return t.text if t and t.kind in ("op", "word") else ""

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            found = self.items[self.at].text if self.at < len(self.items) else "the end"
            raise ParseError(f"expected {text}, found {found}")

    def select(self) -> str | None:
        """The text of a SELECT in parentheses, if one stands here."""
        ahead = self.items[self.at + 1] if self.at + 1 < len(self.items) else None
        if self.peek() != "(" or ahead is None or ahead.kind != "name" or ahead.text.lower() != "select":
            return None
        depth, start = 0, ahead.at
        while self.at < len(self.items):
            depth += (self.peek() == "(") - (self.peek() == ")")
            self.at += 1
            if not depth:
                return self.text[start : self.items[self.at - 1].at].strip()
        raise ParseError("expected ), found the end")

    def whole(self) -> Node:
        node = self.expression(0)
        if self.at < len(self.items):
            raise ParseError(f"left over: {self.items[self.at].text}")
        return node

    def expression(self, least: int) -> Node:
        left = self.prefix()
        while True:
            word = self.peek()
            if word in COMPARISONS or word in ("like", "in", "between", "is") or (word == "not" and self.peek(1) in ("like", "in", "between")):
                if LEVELS["compare"] < least:
                    return left
                left = self.comparison(left)
                continue
            level = LEVELS.get(word, 0) if word not in ("not", "unary", "compare") else 0
            if not level or level < least:
                return left
            self.at += 1
            left = Node("binary", word, (left, self.expression(level + 1)))

    def comparison(self, left: Node) -> Node:
        negated = self.take("not")
        word, inner = self.peek(), LEVELS["compare"] + 1
        self.at += 1
        if word == "is":
            negated = self.take("not")
            self.need("null")
            return Node("isnull", "", (left,), negated)
        if word == "between":
            low = self.expression(inner)
            self.need("and")
            return Node("between", "", (left, low, self.expression(inner)), negated)
        if word == "in":
            inner = self.select()
            if inner is not None:
                return Node("in_query", inner, (left,), negated)
            self.need("(")
            return Node("in", "", (left, *self.arguments(")")), negated)
        if word == "like":
            return Node("like", "", (left, self.expression(inner)), negated)
        ahead = self.items[self.at] if self.at < len(self.items) else None
        if ahead is not None and ahead.kind == "name" and ahead.text.lower() in ("any", "some", "all"):
            self.at += 1
            query = self.select()
            if query is not None:
                return Node("quantified", query, (left,), path=(word, "all" if ahead.text.lower() == "all" else "any"))
            self.at -= 1
        return Node("binary", word, (left, self.expression(inner)))

    def arguments(self, close: str) -> list[Node]:
        out: list[Node] = []
        if self.take(close):
            return out
        while True:
            out.append(Node("null") if self.peek() in (",", close) else self.expression(0))
            if not self.take(",") and not self.take(";"):
                self.need(close)
                return out

    def prefix(self) -> Node:
        if self.take("not"):
            return Node("unary", "not", (self.expression(LEVELS["not"]),))
        if self.peek() in ("-", "+"):
            sign = self.peek()
            self.at += 1
            return Node("unary", sign, (self.expression(LEVELS["unary"]),))
        return self.postfix()

    def postfix(self) -> Node:
        node = self.primary()
        while True:
            if self.peek() in (".", "!"):
                self.at += 1
                if self.take("*"):
                    return Node("star", "*", (), path=(*node.path, "*"))
                if self.at >= len(self.items) or self.items[self.at].kind not in ("name", "quoted", "word"):
                    raise ParseError("expected a name after a dot")
                part = self.items[self.at]
                self.at += 1
                if node.kind not in ("name", "member"):
                    raise ParseError("a member of something unnamed")
                name = part.text[1:-1] if part.kind == "quoted" else part.text
                node = Node("member", name, (), path=(*node.path, name))
            elif self.peek() == "(" and node.kind in ("name", "member"):
                self.at += 1
                node = Node("call", node.value, tuple(self.arguments(")")), path=node.path)
            else:
                return node

    def primary(self) -> Node:
        if self.at >= len(self.items):
            raise ParseError("unexpected end")
        query = self.select()
        if query is not None:
            return Node("subquery", query)
        t = self.items[self.at]
        self.at += 1
        if t.kind == "name" and t.text.lower() == "exists":
            query = self.select()
            if query is not None:
                return Node("exists", query)
        if t.kind == "op" and t.text == "(":
            node = self.expression(0)
            self.need(")")
            return Node("group", "", (node,))
        if t.kind == "op" and t.text == "*":
            return Node("star", "*", (), path=("*",))
        if t.kind == "string":
            quote = t.text[0]
            return Node("string", t.text[1:-1].replace(quote * 2, quote))
        if t.kind in ("number", "date"):
            return Node(t.kind, t.text.strip("#").strip() if t.kind == "date" else t.text)
        if t.kind == "word" and t.text in ("true", "false"):
            return Node("bool", t.text)
        if t.kind == "word" and t.text == "null":
            return Node("null")
        if t.kind in ("name", "quoted"):
            name = t.text[1:-1] if t.kind == "quoted" else t.text
            return Node("name", name, path=(name,))
        raise ParseError(f"unexpected {t.text}")


def parse(text: str) -> Node | None:
    """The tree of an expression; None for blank text. A leading = is left out."""
    text = text.strip()
    if text.startswith("="):
        text = text[1:].strip()
    return _Parser(text).whole() if text else None


def walk(node: Node):
    yield node
    for child in node.children:
        yield from walk(child)
