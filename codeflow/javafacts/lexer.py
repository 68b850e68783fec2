"""Tokens of Java source with their offsets, and positions in UTF-16 columns."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, char, op
    text: str
    start: int
    end: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>\"\"\".*?(?:(?<!\\)\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?)
    |(?P<char>'(?:\\.|[^'\\\n])*'?)
    |(?P<number>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)[lLfFdD]?)
    |(?P<word>[^\W\d]\w*|[$][\w$]*)
    |(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|.)""",
    re.X | re.S,
)
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind = m.lastgroup
        end = m.end()
        if kind == "word":
            end = _WORD.match(source, at).end()
        if kind != "skip":
            out.append(Token(kind, source[at:end], at, end))
        at = end
    return out


class Positions:
    """Offsets as zero-based (line, UTF-16 column)."""

    def __init__(self, source: str):
        self.source = source
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.wide = [i for i, c in enumerate(source) if c > "￿"]

    def at(self, offset: int) -> dict:
        line = bisect.bisect_right(self.lines, offset) - 1
        start = self.lines[line]
        extra = bisect.bisect_left(self.wide, offset) - bisect.bisect_left(self.wide, start)
        return {"line": line, "column": offset - start + extra}

    def span(self, uri: str, start: int, end: int) -> dict:
        return {"uri": uri, "start": self.at(start), "end": self.at(end)}
