"""From tokens to the parts of a grammar program."""

from __future__ import annotations

from ..errors import ParseError
from . import ast
from .lexer import Places, Token, tokenize


class _NoParse(Exception):
    """A construct that isn't there."""


class _Reader:
    """Reads constructs from a position on; a construct that fails leaves the
    position where the caller puts it back."""

    def __init__(self, tokens: list[Token]):
        self.tokens = tokens
        self.at = 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at].kind

    def take(self, *kinds: str) -> str:
        token = self.tokens[self.at]
        if token.kind not in kinds:
            raise _NoParse
        self.at += 1
        return token.text

    def drop(self, *kinds: str) -> int:
        """Pass over tokens; the length of their text."""
        n = 0
        while self.kind in kinds:
            n += len(self.tokens[self.at].text)
            self.at += 1
        return n

    def attempt(self, construct):
        start = self.at
        try:
            return construct()
        except _NoParse:
            self.at = start
            return None

    # --- constructs ---

    def expression(self) -> ast.Expression:
        kind, text = self.kind, self.tokens[self.at].text
        if kind in ("string", "regex"):
            self.at += 1
            return (ast.Text if kind == "string" else ast.Pattern)(text[1:-1])
        if kind == "number" and int(text) < 1 << 63:
            self.at += 1
            return ast.Number(int(text))
        if kind == "capture":
            self.at += 1
            body = text[1:]
            return ast.Group(int(body)) if body.isdigit() else ast.NamedGroup(body)
        return ast.Name(self.take("name"))

    def fields(self) -> tuple[ast.Expression, ...]:
        """One or more expressions, over lines, up to a colon, a bar or a keyword."""
        out = []
        while True:
            self.drop("newline", "indent")
            e = self.attempt(self.expression)
            if e is None:
                break
            out.append(e)
        if not out:
            raise _NoParse
        return tuple(out)

    def call(self) -> ast.Call:
        name = self.take("name")
        if self.kind != "(":
            return ast.Call(name)
        self.at += 1
        args = []
        while self.kind != ")":
            args.append(self.expression())
            if self.kind == ",":
                self.at += 1
        self.at += 1
        return ast.Call(name, tuple(args))

    def actions(self) -> tuple[ast.Call, ...]:
        """The calls of a block: it ends where the indent gets smaller than
        that of its first indented call, or something else follows."""
        out: list[ast.Call] = []
        base = 0
        while True:
            start = self.at
            self.drop("newline")
            indent = self.drop("indent")
            found = None if indent < base else self.attempt(self.call)
            if found is None:
                self.at = start
                break
            base = base or indent
            out.append(found)
        if not out:
            raise _NoParse
        return tuple(out)

    def statement(self) -> ast.Statement:
        self.drop("newline")
        self.drop("indent")
        if self.kind == "skip":
            self.at += 1
            return ast.Skip(self.expression())
        if self.kind in ("match", "imatch", "when"):
            keyword = self.take(self.kind)
            alternatives = [self.fields()]
            while self.kind == "|":
                self.at += 1
                alternatives.append(self.fields())
            self.take(":")
            return ast.Match(tuple(alternatives), self.actions(), keyword == "imatch", keyword != "when")
        return self.call()

    def define(self) -> tuple[str, ast.Expression]:
        self.take("define")
        return self.take("name"), self.expression()

    def grammar(self) -> ast.Rules:
        self.take("grammar")
        name, parent = self.take("name"), None
        if self.kind == "(":
            self.at += 1
            parent = self.take("name")
            self.take(")")
        self.take(":")
        statements = []
        while (s := self.attempt(self.statement)) is not None:
            statements.append(s)
        return ast.Rules(name, parent, tuple(statements))

    def source(self) -> ast.Source:
        defines: dict[str, ast.Expression] = {}
        grammars: dict[str, ast.Rules] = {}
        while True:
            self.drop("newline")
            if (d := self.attempt(self.define)) is not None:
                defines[d[0]] = d[1]
            elif (g := self.attempt(self.grammar)) is not None:
                grammars[g.name] = g
            else:
                return ast.Source(defines, grammars)


def parse(text: str) -> ast.Source:
    """Parse a program; what no construct takes is an error at its place."""
    reader = _Reader(tokenize(text))
    source = reader.source()
    if reader.kind != "end":
        token = reader.tokens[reader.at]
        raise ParseError("unexpected token Tag", Places(text).span(token.offset, token.text))
    return source
