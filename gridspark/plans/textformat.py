"""The text form of saved definitions: nested blocks of properties.

    Key =value          a property; quoted values go on over quoted lines
    dbType "Key" =value a typed property
    Key = Begin ... End a binary value, kept as its lines
    Begin [Type] ... End a block
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DEEPEST = 200
_PROPERTY = re.compile(r'\s*(?:(?P<type>db\w+)\s+"(?P<typed>[^"]*)"|(?P<key>[A-Za-z_][\w.]*))\s*=\s*(?P<value>.*)$')
_BEGIN = re.compile(r"\s*Begin(?:\s+(?P<type>\S.*?))?\s*$")
_QUOTED = re.compile(r'\s*"(?P<body>(?:[^"\\]|\\.|"")*)"\s*$', re.S)
_ESCAPE = re.compile(r'\\(?:([0-7]{3})|(["\\]))')


def unescape(text: str) -> str:
    """Octal escapes, escaped quotes and backslashes; other escapes stay as they are."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 8)) if m[1] else m[2], text)


@dataclass(frozen=True)
class Property:
    key: str
    value: str
    db_type: str | None = None
    binary: tuple[str, ...] | None = None


@dataclass
class Block:
    type_name: str | None = None
    properties: list[Property] = field(default_factory=list)
    children: list[Block] = field(default_factory=list)

    def get(self, key: str, default: str | None = None) -> str | None:
        return next((p.value for p in self.properties if p.key.casefold() == key.casefold()), default)

    def all(self, key: str) -> list[str]:
        return [p.value for p in self.properties if p.key.casefold() == key.casefold()]

    def blocks(self, type_name: str) -> list[Block]:
        return [b for b in self.children if (b.type_name or "").casefold() == type_name.casefold()]

    def walk(self):
        yield self
        for child in self.children:
            yield from child.walk()


def _quoted(line: str) -> str | None:
    m = _QUOTED.match(line) if '"' in line else None
    return None if m is None else unescape(m["body"].replace('""', '"'))


def parse_text(text: str) -> Block:
    """The tree of a definition; a stray End is passed over, nesting over DEEPEST is an error."""
    root = Block()
    stack = [root]
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        bare = line.strip()
        if not bare:
            continue
        if bare == "End":
            if len(stack) > 1:
                stack.pop()
            continue
        begin = _BEGIN.match(line) if "=" not in bare else None
        if begin:
            if len(stack) >= DEEPEST:
                raise ValueError("blocks are nested too deeply")
            block = Block(begin["type"])
            stack[-1].children.append(block)
            stack.append(block)
            continue
        m = _PROPERTY.match(line)
        if not m:
            continue
        key, value = m["typed"] if m["type"] else m["key"], m["value"].strip()
        if value == "Begin":
            body = []
            while at < len(lines) and lines[at].strip() != "End":
                body += [part.strip() for part in lines[at].split(",") if part.strip()]
                at += 1
            at += 1
            stack[-1].properties.append(Property(key, "", m["type"], tuple(body)))
            continue
        first = _quoted(value)
        if first is None:
            stack[-1].properties.append(Property(key, value, m["type"]))
            continue
        while at < len(lines) and (more := _quoted(lines[at])) is not None:
            first += more
            at += 1
        stack[-1].properties.append(Property(key, first, m["type"]))
    return root


def split_code(text: str) -> tuple[str, str | None]:
    """A definition and the module code behind it, None where there is none."""
    m = re.search(r"^Option (?:Compare Database|Explicit)\b", text, re.M)
    return (text, None) if m is None else (text[: m.start()], text[m.start() :])
