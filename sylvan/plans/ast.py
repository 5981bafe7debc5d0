"""The parts of a grammar program, as immutable values that can be pickled."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Pattern:
    value: str


@dataclass(frozen=True)
class Number:
    value: int


@dataclass(frozen=True)
class Name:
    """A reference to a define."""

    value: str


@dataclass(frozen=True)
class Group:
    """``$3``: a capture by position."""

    index: int


@dataclass(frozen=True)
class NamedGroup:
    """``$name``: a capture by name."""

    name: str


Expression = Text | Pattern | Number | Name | Group | NamedGroup


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expression, ...] = ()


@dataclass(frozen=True)
class Match:
    """``match``, ``imatch`` or ``when``: alternatives of field lists, tried in order."""

    alternatives: tuple[tuple[Expression, ...], ...]
    actions: tuple[Call, ...]
    ignore_case: bool = False
    consumes: bool = True


@dataclass(frozen=True)
class Skip:
    pattern: Expression


Statement = Match | Skip | Call


@dataclass(frozen=True)
class Rules:
    """One ``grammar`` of a program."""

    name: str
    parent: str | None
    statements: tuple[Statement, ...]


@dataclass(frozen=True)
class Source:
    """A parsed program: what stands in its text, in order."""

    defines: dict[str, Expression] = field(default_factory=dict)
    grammars: dict[str, Rules] = field(default_factory=dict)


def to_json_value(source: Source) -> dict:
    """The program as plain dictionaries and lists."""

    def expression(e: Expression) -> dict:
        match e:
            case Group(i):
                return {"type": "capture", "index": i}
            case NamedGroup(n):
                return {"type": "capture_name", "name": n}
        kind = {Text: "string", Pattern: "regex", Name: "variable", Number: "number"}[type(e)]
        return {"type": kind, "value": e.value}

    def call(c: Call, kind: str) -> dict:
        return {"type": kind, "name": c.name, "args": [expression(a) for a in c.args]}

    def statement(s: Statement) -> dict:
        if isinstance(s, Call):
            return call(s, "action")
        if isinstance(s, Skip):
            return {"type": "skip", "pattern": expression(s.pattern)}
        lists = [{"expressions": [expression(e) for e in a], "flags": int(s.ignore_case)} for a in s.alternatives]
        head = {"type": "match", "case_insensitive": s.ignore_case} if s.consumes else {"type": "when"}
        return head | {"patterns": lists, "actions": [call(c, "call") for c in s.actions]}

    def rules(g: Rules) -> dict:
        out = {"inherit": g.parent} if g.parent is not None else {}
        return out | ({"statements": [statement(s) for s in g.statements]} if g.statements else {})

    out = {}
    if source.defines:
        out["defines"] = {k: expression(v) for k, v in source.defines.items()}
    if source.grammars:
        out["grammars"] = {k: rules(v) for k, v in source.grammars.items()}
    return out
