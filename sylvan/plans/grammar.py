"""A compiled grammar: what plans, kernels and tasks share."""

from __future__ import annotations

import functools
import json
import warnings
from dataclasses import dataclass, field

from ..errors import Diagnostic, ValidationError
from . import ast
from .analysis import patterns_of, validate
from .dialect import nests_repeats
from .parser import parse

#: Bytes that one pattern can span, unless told otherwise.
DEFAULT_WINDOW = 1000


@dataclass(frozen=True)
class Grammar:
    """A checked program with its options.  It is immutable and small; tasks get
    it in their closures and build its kernel once per Python worker."""

    text: str
    preserve_case: bool = False
    window: int = DEFAULT_WINDOW
    source: ast.Source = field(default_factory=ast.Source, compare=False, repr=False)
    diagnostics: tuple[Diagnostic, ...] = field(default=(), compare=False, repr=False)

    @classmethod
    def compile(cls, text: str, *, preserve_case: bool = False, search_window: int | None = None) -> Grammar:
        """Parse and check a program; what can't run is a ValueError here, on the driver."""
        if search_window is not None and search_window < 1:
            raise ValueError("search_window must be at least 1")
        source = parse(text)
        found = validate(source)
        for d in found:
            if d.severity == "error":
                raise ValidationError(d.message, d.span)
        for p in patterns_of(source):
            if nests_repeats(p.value):
                warnings.warn(f"the pattern /{p.value}/ nests unlimited repeats, which can take time that doubles with each character", stacklevel=2)
        return cls(text, preserve_case, DEFAULT_WINDOW if search_window is None else search_window, source, tuple(found))

    def __reduce__(self):
        return _again, (self.text, self.preserve_case, self.window)

    def machine(self):
        """The kernel of this grammar, made once per process."""
        return _machine(self)

    def to_json(self) -> str:
        return json.dumps(ast.to_json_value(self.source), ensure_ascii=False, indent=2)


def _again(text: str, preserve_case: bool, window: int) -> Grammar:
    return Grammar(text, preserve_case, window, parse(text))


@functools.lru_cache(maxsize=64)
def _machine(grammar: Grammar):
    from ..operators.kernel import Machine

    return Machine(grammar.source, grammar.preserve_case, grammar.window)


def parse_to_json(text: str) -> str:
    """The parts of a program as JSON text."""
    return json.dumps(ast.to_json_value(parse(text)), ensure_ascii=False, indent=2)
