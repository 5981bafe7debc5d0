"""Errors and diagnostics, with places in the source of a grammar."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    """A place in a source: bytes from its start, line and column from 1, and
    a length in bytes."""

    offset: int
    line: int
    col: int
    length: int = 0

    def __str__(self) -> str:
        return f"{self.line}:{self.col}"


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    message: str
    span: Span | None = None

    def __str__(self) -> str:
        return f"{self.severity} at {self.span}: {self.message}" if self.span else f"{self.severity}: {self.message}"


class GrammarError(ValueError):
    """A grammar that can't be compiled."""

    what = "error"

    def __init__(self, message: str, span: Span | None = None):
        super().__init__(f"{span or 'unknown'}: {self.what}: {message}")
        self.message = message
        self.span = span


class LexError(GrammarError):
    what = "lex error"


class ParseError(GrammarError):
    what = "parse error"


class ValidationError(GrammarError):
    what = "validation error"


class ParsingFailed(RuntimeError):
    """A text that a grammar can't parse, or a tree that a format can't hold."""
