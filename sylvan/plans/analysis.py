"""Checks of a parsed program, and the passes that make it ready to run."""

from __future__ import annotations

from collections.abc import Iterator

from ..errors import Diagnostic
from . import ast
from .dialect import PatternError, to_python


def _calls(s: ast.Statement) -> tuple[ast.Call, ...]:
    return (s,) if isinstance(s, ast.Call) else s.actions if isinstance(s, ast.Match) else ()


def _expressions(s: ast.Statement) -> Iterator[ast.Expression]:
    if isinstance(s, ast.Skip):
        yield s.pattern
    elif isinstance(s, ast.Match):
        for fields in s.alternatives:
            yield from fields
    for c in _calls(s):
        yield from c.args


def patterns_of(source: ast.Source) -> list[ast.Pattern]:
    """The distinct patterns of a program."""
    found = [e for e in source.defines.values() if isinstance(e, ast.Pattern)]
    found += [e for g in source.grammars.values() for s in g.statements for e in _expressions(s) if isinstance(e, ast.Pattern)]
    return list(dict.fromkeys(found))


def validate(source: ast.Source) -> list[Diagnostic]:
    """Warnings about names that nothing defines; errors for patterns that
    can't be compiled and parents that aren't there."""
    out: list[Diagnostic] = []
    every = [(g.name, s) for g in source.grammars.values() for s in g.statements]
    for name, s in every:
        for c in _calls(s):
            if not c.args and not c.name.startswith(("do.", "out.")) and c.name not in source.grammars:
                out.append(Diagnostic("warning", f"undefined grammar reference '{c.name}' in grammar '{name}'"))
    for name, s in every:
        for e in _expressions(s):
            if isinstance(e, ast.Name) and e.value not in source.defines:
                out.append(Diagnostic("warning", f"undefined variable '{e.value}' in grammar '{name}'"))
    for p in patterns_of(source):
        try:
            to_python(p.value, ascii_only=True)
        except PatternError as e:
            out.append(Diagnostic("error", f"invalid regex '{p.value}': {e}"))
    for g in source.grammars.values():
        if g.parent is not None and g.parent not in source.grammars:
            out.append(Diagnostic("error", f"grammar '{g.name}' inherits from undefined grammar '{g.parent}'"))
    return out


def resolve(e: ast.Expression, defines: dict[str, ast.Expression]) -> ast.Expression:
    """Follow a name through the defines to what it stands for; a name without
    an end, or in a circle, stays."""
    seen = set()
    at = e
    while isinstance(at, ast.Name):
        if at.value in seen or at.value not in defines:
            return e
        seen.add(at.value)
        at = defines[at.value]
    return at


def flatten(source: ast.Source, name: str) -> tuple[ast.Statement, ...]:
    """The statements of a grammar behind those of its ancestors, oldest first."""
    line: list[ast.Rules] = []
    at: str | None = name
    while at is not None and at in source.grammars and source.grammars[at] not in line:
        line.append(source.grammars[at])
        at = line[-1].parent
    return tuple(s for g in reversed(line) for s in g.statements)
