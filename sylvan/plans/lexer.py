"""Tokens of the grammar language."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import LexError, Span


class Token(NamedTuple):
    kind: str
    text: str
    offset: int  # in characters


_WORD_END = r"(?!\w)"
#: One alternative per kind, in order of precedence.
_TOKEN = re.compile(
    rf"""
      (?P<newline>(?:\r?\n)+)
    | (?P<blank>[^\S\r\n]+)
    | (?P<comment>[#!][^\r\n]*)
    | (?P<keyword>(?:define|grammar|imatch|match|when|skip){_WORD_END})
    | (?P<string>'(?:\\.|[^\\'])*'|"(?:\\.|[^\\"])*")
    | (?P<regex>/(?:\\.|[^\\/])*/)
    | (?P<number>[0-9]+(?![^\W\d]|_))
    | (?P<capture>\$[A-Za-z0-9_]+)
    | (?P<name>[A-Za-z0-9_][A-Za-z0-9_\-./@]*)
    | (?P<mark>[:|,=()])
    """,
    re.VERBOSE | re.DOTALL,
)
_INDENT = re.compile(r"\ {4,}|\t+")


class Places:
    """Spans of character offsets in one source."""

    def __init__(self, source: str):
        self.source = source

    def span(self, offset: int, text: str = "") -> Span:
        before = self.source[:offset]
        return Span(len(before.encode()), before.count("\n") + 1, offset - (before.rfind("\n") + 1) + 1, len(text.encode()))


def tokenize(source: str) -> list[Token]:
    """All tokens but comments and blanks within a line, and an end token.  At
    the start of a line four or more spaces, or tabs, are an indent."""
    tokens: list[Token] = []
    at, line_start = 0, True
    while at < len(source):
        if line_start and (m := _INDENT.match(source, at)):
            tokens.append(Token("indent", m[0], at))
            at, line_start = m.end(), False
            continue
        line_start = False
        m = _TOKEN.match(source, at)
        if not m:
            raise LexError(f"Unexpected character '{source[at]}'", Places(source).span(at, source[at]))
        kind = m.lastgroup
        if kind not in ("blank", "comment"):
            tokens.append(Token(m[0] if kind in ("keyword", "mark") else kind, m[0], at))
        line_start = kind == "newline"
        at = m.end()
    tokens.append(Token("end", "", at))
    return tokens
