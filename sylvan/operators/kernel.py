"""Evaluates a compiled grammar over one text.

A text is walked from left to right with one cursor, so this is the part that
can't be spread over rows: the kernel runs inside Arrow batches, one text at a
time.  Rules and actions are turned into closures once per Python worker.
"""

from __future__ import annotations

import functools
import gc
import os
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions.text import debug_string, line_number, percent_decode, percent_encode
from ..plans import ast
from ..plans.analysis import flatten, resolve
from ..plans.dialect import PatternError, to_python
from .tree import Node, Tree, identity, parse_path

MOST_LEVELS = 250

#: Characters by which rules are chosen, behind what all of a grammar's rules
#: begin with and in all; and how many such texts a grammar remembers.
_BEHIND, _SEEN, _PICKED = 3, 16, 3000

#: What an action wants of its block: go on, or end it in one of these ways.
_SKIP, _BREAK, _NEXT, _RETURN = 1, 2, 3, 4


@dataclass
class Outcome:
    """What a run gives: the tree, and how it went."""

    tree: Tree
    consumed: int = 0
    error: str | None = None
    traces: list[str] = field(default_factory=list)
    diagnostics: list[tuple[str, str]] = field(default_factory=list)
    actions: list[tuple[str, tuple[ast.Expression, ...]]] = field(default_factory=list)
    captures: list[list[str]] = field(default_factory=list)
    capture_names: list[list[str]] = field(default_factory=list)


class _Starts:
    """The characters that a pattern's match can begin with.  Answers yes where
    it can't tell, and for a pattern that matches nothing at all as well."""

    def __init__(self, source: str, ignore_case: bool):
        self.ignore_case = ignore_case
        self.items: list[tuple[str, object]] = []
        self.any = self._gather(re._parser.parse(source))

    def _gather(self, items) -> bool:
        """Collect what can stand first; whether it can be anything, or nothing."""
        for op, arg in items:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                self.items.append((name, arg))
                return False
            if name in ("MAX_REPEAT", "MIN_REPEAT"):
                if not self._gather(arg[2]) and arg[0] > 0:
                    return False
            elif name == "SUBPATTERN" and not arg[1] and not arg[2] & ~re.IGNORECASE:
                if not self._gather(arg[3]):
                    return False
            elif name == "BRANCH":
                if not any([self._gather(b) for b in arg[1]]):
                    return False
            elif name != "AT":
                return True
        return True

    def __call__(self, c: str) -> bool:
        if self.any:
            return True
        forms = {c, c.lower(), c.upper()} if self.ignore_case else {c}
        if self.ignore_case and not c.isascii():
            return True
        return any(_is_in(name, arg, f) for name, arg in self.items for f in forms if len(f) == 1)


def _is_in(name: str, arg, c: str) -> bool:
    if name == "LITERAL":
        return ord(c) == arg
    if name == "NOT_LITERAL":
        return ord(c) != arg
    if name == "ANY":
        return True
    inside = False
    for op, a in arg:
        kind = str(op)
        if kind == "LITERAL":
            inside |= ord(c) == a
        elif kind == "RANGE":
            inside |= a[0] <= ord(c) <= a[1]
        elif kind == "CATEGORY":
            short = str(a).removeprefix("CATEGORY_")
            inside |= bool(re.match({"DIGIT": r"\d", "NOT_DIGIT": r"\D", "SPACE": r"\s", "NOT_SPACE": r"\S", "WORD": r"\w", "NOT_WORD": r"\W"}[short], c))
    return inside != bool(arg and str(arg[0][0]) == "NEGATE")


def _prefix(items) -> str:
    """The literal text that a parsed pattern begins with."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
            out += (inner := _prefix(arg[3]))
            if len(inner) < len(arg[3]):
                break
        else:
            break
    return out


class _Matcher:
    """A pattern to be tried at the cursor, within the window: in a short form
    for texts of ASCII, and one for others that is made where it is needed."""

    __slots__ = ("ascii", "wide", "sliced", "names", "pattern", "flags", "prefix", "_starts")

    def __init__(self, pattern: str, ignore_case: bool):
        source, self.sliced = to_python(pattern, ascii_only=True, ignore_case=ignore_case)
        self.pattern, self.flags = pattern, re.IGNORECASE if ignore_case else 0
        compiled = re.compile(source, self.flags)
        self.ascii = compiled.match
        self.wide = None
        self.prefix = "" if ignore_case else _prefix(re._parser.parse(source))[:_SEEN]
        self._starts: list[_Starts | None] = [_Starts(source, ignore_case), None]
        self.names = [None] * (compiled.groups + 1)
        for name, i in compiled.groupindex.items():
            self.names[i] = name

    def _wide_source(self) -> str:
        return to_python(self.pattern, ignore_case=bool(self.flags))[0]

    def of(self, run: Run) -> Callable:
        """What matches in the text of a run."""
        if run.sizes is None:
            return self.ascii
        if self.wide is None:
            self.wide = re.compile(self._wide_source(), self.flags).match
        return self.wide

    def repeated(self) -> Callable | None:
        """What matches as often as the pattern does, each time as if alone, in
        texts of ASCII; None if that can't be said in one pattern."""
        source = to_python(self.pattern, ascii_only=True, ignore_case=bool(self.flags))[0]
        if re.search(r"\\[1-9]|\(\?\(", source):
            return None
        try:
            return re.compile(f"(?:(?>{source}))+", self.flags).match
        except re.PatternError:
            return None

    def starts(self, seen: str) -> bool:
        """Whether a match may begin where these characters stand; there may be more behind them."""
        n = len(seen)
        if seen != self.prefix[:n] and not seen.startswith(self.prefix):
            return False
        c = seen[0]
        if c.isascii() and not self.flags:
            return self._starts[0](c)
        if self._starts[1] is None:
            self._starts[1] = _Starts(self._wide_source(), bool(self.flags))
        return self._starts[1](c)


class _Block:
    """The actions of a rule, and what its log needs."""

    __slots__ = ("steps", "calls", "has_groups")

    def __init__(self, steps, calls: tuple[ast.Call, ...]):
        self.steps = steps
        self.calls = calls
        self.has_groups = any(isinstance(a, ast.Group | ast.NamedGroup) for c in calls for a in c.args)


class Machine:
    """A program, ready to run over any number of texts."""

    def __init__(self, source: ast.Source, preserve_case: bool, window: int):
        self.source = source
        self.preserve_case = preserve_case
        self.window = window
        self.paths: dict = {}
        #: For each grammar and character, the rules that may match there.
        self.picked: dict[str, dict[str, list]] = {name: {} for name in source.grammars}
        self.rules: dict[str, list] = {name: [] for name in source.grammars}
        for name in source.grammars:
            for s in flatten(source, name):
                rule = self._rule(s)
                self.rules[name].append((*rule, self._shortcut(rule, not self.rules[name])))
        #: For each grammar, how many characters at the cursor choose its rules.
        self.seen = {name: self._to_see(name) for name in source.grammars}

    # --- compilation ---

    def _rule(self, s: ast.Statement):
        if isinstance(s, ast.Skip):
            skip = self._skip(resolve(s.pattern, self.source.defines))
            return ("skip", skip, None, getattr(skip, "starts", None))
        if isinstance(s, ast.Call):
            if self._is_grammar(s.name):
                return ("grammar", s.name, None, None)
            args = tuple(resolve(a, self.source.defines) for a in s.args)
            return ("action", self._block((ast.Call(s.name, args),)), None, None)
        tests = [self._fields(f, s.ignore_case) for f in s.alternatives]
        test = tests[0] if len(tests) == 1 else self._first_of(tests)
        starts = [getattr(t, "starts", None) for t in tests]
        known = None if None in starts else lambda c: any(f(c) for f in starts)
        return ("match" if s.consumes else "when", test, self._block(s.actions), known)

    def _to_see(self, name: str) -> int:
        prefixes = [p for p in (getattr(r[1], "prefix", "") for r in self.rules[name] if r[0] in ("match", "when")) if p]
        return min(_SEEN, len(os.path.commonprefix(prefixes)) + _BEHIND) if prefixes else 1

    def pick(self, name: str, seen: str) -> list:
        """The rules of a grammar that may match where ``seen`` stands; all that
        need no character, at the end of the text.  Where too many texts were
        seen, the first character decides."""
        picked = self.picked[name]
        if len(picked) >= _PICKED and len(seen) > 1:
            seen = seen[0]
            if seen in picked:
                return picked[seen]
        rules = [r for r in self.rules[name] if r[3] is None or (r[3](seen) if seen else True)]
        if len(picked) < _PICKED or (len(seen) == 1 and len(picked) < 2 * _PICKED):
            picked[seen] = rules
        return rules

    def _is_grammar(self, name: str) -> bool:
        return "." not in name and name in self.source.grammars

    @staticmethod
    def _first_of(tests):
        def first(run):
            for test in tests:
                if (got := test(run)) is not None:
                    return got
            return None

        return first

    def _fields(self, fields: tuple[ast.Expression, ...], ignore_case: bool):
        """A test that gives (end, captures, names) or None."""
        first = resolve(fields[0], self.source.defines)
        if ignore_case and isinstance(first, ast.Text) and first.value:
            return self._behind_prefix(_ascii_lower(first.value), self._parts(fields, ignore_case))
        return self._parts(fields, ignore_case)

    @staticmethod
    def _behind_prefix(prefix: str, test):
        """A literal in front is compared first, and only the case of ASCII letters is ignored there."""
        n = len(prefix)

        def behind(run):
            return test(run) if _ascii_lower(run.text[run.pos : run.pos + n]) == prefix else None

        if hasattr(test, "starts"):
            behind.starts = test.starts
        return behind

    def _parts(self, fields: tuple[ast.Expression, ...], ignore_case: bool):
        parts = [self._as_pattern(resolve(e, self.source.defines)) for e in fields]
        if None not in parts:
            try:
                return self._fused(_Matcher("".join(f"({p})" for p in parts), ignore_case), fields)
            except (PatternError, re.PatternError):
                pass
        return self._one_by_one([self._field(resolve(e, self.source.defines), ignore_case) for e in fields])

    @staticmethod
    def _as_pattern(e: ast.Expression) -> str | None:
        match e:
            case ast.Text(t):
                return re.sub(r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\\1", t)
            case ast.Pattern(p):
                return p
            case ast.Number(n):
                return str(n)
        return None

    def _fused(self, matcher: _Matcher, fields):
        match, of = matcher.ascii, matcher.of
        names = [None] * (len(matcher.names) - 1)
        window = self.window

        if matcher.sliced:

            def test(run):
                m = of(run)(run.text[run.pos : run.reach()])
                return m and (run.pos + m.end(), m.groups(""), names)

        else:

            def test(run):
                pos = run.pos
                m = match(run.text, pos, pos + window) if run.sizes is None else of(run)(run.text, pos, run.reach())
                return m and (m.end(), m.groups(""), names)

            test.parts = match, matcher, names
        test.prefix = matcher.prefix
        test.starts = matcher.starts
        return test

    @staticmethod
    def _one_by_one(fields):
        def test(run):
            at, captures, names = run.pos, [], []
            for f in fields:
                got = f(run, at, captures, names)
                if got is None:
                    return None
                at, more, more_names = got
                captures += more
                names += more_names
            return at, captures, names

        return test

    def _field(self, e: ast.Expression, ignore_case: bool):
        """A test of one field of a list that can't be one pattern."""

        def same(a: str, b: str) -> bool:
            return a == b or (ignore_case and len(a.encode()) == len(b.encode()) and _ascii_lower(a) == _ascii_lower(b))

        def literal(run, at, s, value=None):
            end = at + len(s)
            return (end, [s if value is None else value], [None]) if same(run.text[at:end], s) else None

        match e:
            case ast.Text(t):
                return lambda run, at, captures, names: literal(run, at, t)
            case ast.Number(n):
                t = str(n)
                return lambda run, at, captures, names: (at + len(t), [t], [None]) if run.text.startswith(t, at) else None
            case ast.Group(i):
                return lambda run, at, captures, names: literal(run, at, captures[i]) if i < len(captures) else None
            case ast.NamedGroup(name):
                return lambda run, at, captures, names: literal(run, at, captures[names.index(name)]) if name in names else None
            case ast.Pattern(p):
                matcher = _Matcher(f"(?:{p})", ignore_case)

                def pattern(run, at, captures, names):
                    m = matcher.of(run)(run.text[at : run.reach(at)]) if matcher.sliced else matcher.of(run)(run.text, at, run.reach(at))
                    return m and ((at if matcher.sliced else 0) + m.end(), [m[0], *m.groups("")], matcher.names)

                return pattern
        return lambda run, at, captures, names: None

    def _skip(self, e: ast.Expression):
        """A function that gives the end of what is skipped, or None."""
        match e:
            case ast.Text(t):
                return lambda run: run.pos + len(t) if run.text.startswith(t, run.pos) else None
            case ast.Number(n):
                t = str(n)
                return lambda run: run.pos + len(t) if run.text.startswith(t, run.pos) else None
            case ast.Pattern(p):
                matcher = _Matcher(f"(?:{p})", False)
                match, of = matcher.ascii, matcher.of
                whole = p in _UNLIMITED

                if matcher.sliced:

                    def skip(run):
                        m = of(run)(run.text[run.pos : run.reach()])
                        return m and run.pos + m.end()

                else:

                    def skip(run):
                        m = (match if run.sizes is None else of(run))(run.text, run.pos, len(run.text) if whole else run.reach())
                        return m and m.end()

                    skip.parts = match, matcher, whole
                skip.starts = matcher.starts
                return skip
        return lambda run: None

    def _template(self, e: ast.Expression) -> str | Callable:
        """A constant, or a function of the run and of the block's captures.
        A define that stands for a capture has no value here."""
        named = isinstance(e, ast.Name)
        e = resolve(e, self.source.defines)
        if named and isinstance(e, ast.Group | ast.NamedGroup):
            return ""
        match e:
            case ast.Number(n):
                return str(n)
            case ast.Pattern(p):
                return f"/{p}/"
            case ast.Group(i):
                return lambda run, captures, names: percent_encode(captures[i]) if i < len(captures) else ""
            case ast.NamedGroup(name):
                return lambda run, captures, names: percent_encode(captures[names.index(name)]) if name in names else ""
            case ast.Text(t) if "$" in t:
                parts = _split_template(t)
                return lambda run, captures, names: "".join([p if isinstance(p, str) else percent_encode(run.capture(p[0])) for p in parts])
            case ast.Text(t):
                return t
        return ""

    def _plain_text(self, e: ast.Expression) -> Callable | None:
        """A template for node text, where coding its captures and decoding the
        whole again changes nothing: where no literal part has a percent sign."""
        if isinstance(e, ast.Name):
            e = resolve(e, self.source.defines)
            e = ast.Text("") if isinstance(e, ast.Group) else e
        match e:
            case ast.Group(i):
                return lambda run, captures, names: captures[i] if i < len(captures) else ""
            case ast.Text(t) if "$" in t and "%" not in t:
                parts = _split_template(t)
                if len(parts) == 2 and not isinstance(parts[0], str) and not parts[1]:
                    token = parts[0][0]
                    return lambda run, captures, names: run.capture(token)
                if sum(not isinstance(p, str) for p in parts) == 1 and (at := next(k for k, p in enumerate(parts) if not isinstance(p, str))) >= 0 and parts[at][0].isdigit():
                    head, i, tail = "".join(parts[:at]), int(parts[at][0]), "".join(parts[at + 1 :])
                    return lambda run, captures, names: f"{head}{run.captures[i] if i < len(run.captures) else ''}{tail}"
                return lambda run, captures, names: "".join([p if isinstance(p, str) else run.capture(p[0]) for p in parts])
        return None

    def _block(self, calls: tuple[ast.Call, ...]) -> _Block:
        steps = []
        for i, c in enumerate(calls):
            if self._is_grammar(c.name):
                steps.append(self._call_grammar(c.name, i > 0 and calls[i - 1].name == "out.open"))
            elif (step := self._action(c)) is not None:
                steps.append(step)
        return _Block(steps, calls)

    @staticmethod
    def _call_grammar(name: str, after_open: bool):
        def step(run, captures, names):
            used = run.call(name)
            if used and run.record:
                run.out.traces.append(f"subgrammar {name} consumed {used} chars")
            if after_open:
                run.tree.leave()
                run.to_leave = max(0, run.to_leave - 1)
            return _BREAK if used else 0

        return step

    # --- shortcuts: a rule, or an action, as one closure where nothing unusual is in it ---

    def _shortcut(self, rule, first: bool) -> Callable | None:
        """A function that does what :meth:`Run._try` does for a rule, without a
        log; ``first`` tells whether it is the first of its grammar."""
        kind, test, block = rule[0], rule[1], rule[2]
        if kind == "skip" and getattr(test, "parts", None) is not None:
            match, matcher, whole = test.parts
            # A grammar's first rule is tried again right behind itself, so that it may repeat at once.
            repeated = matcher.repeated() if first else None

            def skip(run):
                pos, text = run.pos, run.text
                m = match if run.sizes is None else matcher.wide or matcher.of(run)
                if repeated is not None and run.sizes is None and run.within:
                    m = repeated
                m = m(text, pos) if whole or run.within else m(text, pos, run.reach())
                if m is not None and (end := m.end()) > pos:
                    run.pos = end
                    return _BREAK
                return 0

            return skip
        if kind == "skip":

            def skip(run):
                end = test(run)
                if end is not None and end > run.pos:
                    run.pos = end
                    return _BREAK
                return 0

            return skip
        if kind != "match" or getattr(test, "parts", None) is None:
            return None
        match, matcher, names = test.parts
        window, steps = self.window, block.steps
        # Blocks that neither open nodes nor call grammars leave nothing to be left.
        flat = not any(c.name in ("out.open", "out.enter", "out.leave") or self._is_grammar(c.name) for c in block.calls)
        only = steps[0] if flat and len(steps) == 1 else None

        def fire(run):
            pos = run.pos
            if run.sizes is None:
                m = match(run.text, pos, pos + window)
            else:
                m = matcher.wide or matcher.of(run)
                m = m(run.text, pos) if run.within else m(run.text, pos, run.reach())
            if m is None:
                return 0
            run.matched = m
            run.pos = m.end()
            run.captures = captures = m.groups("")
            run.names = names
            if run.queued:
                run.fire("before")
            if only is not None:
                result = only(run, captures, names)
                if result and result >= _NEXT:
                    return result
            elif flat:
                for step in steps:
                    result = step(run, captures, names)
                    if result:
                        if result >= _NEXT:
                            return result
                        break
            elif result := run.perform(block, captures, names):
                return result
            if run.queued:
                run.fire("after")
            return _BREAK

        return fire

    def _leaf(self, e: ast.Expression) -> tuple | None:
        """Name, attributes and identity of a path of one plain step, where the
        values of attributes are constants or captures: coding a capture and
        decoding it with the path changes nothing."""
        e = resolve(e, self.source.defines)
        if not isinstance(e, ast.Text) or "%" in e.value or "\\" in e.value:
            return None
        parts = _split_template(e.value)
        tokens = [p[0] for p in parts if not isinstance(p, str)]
        if not all(t.isdigit() for t in tokens):
            return None
        # Each capture stands for itself while the path is parsed.
        marks = [f"{i}" for i in range(len(tokens))]
        given = iter(marks)
        path = "".join(p if isinstance(p, str) else next(given) for p in parts)
        steps = parse_path(path, self.preserve_case)
        if "" in e.value or len(steps) != 1 or not path or path.startswith(".") or steps[0][0] in ("", "."):
            return None
        name, attrs = steps[0]
        if "" in name or any("" in k for k, _ in attrs):
            return None
        if not tokens:
            return name, attrs, None
        if any(f'="{v}"' not in path for _, v in attrs) or sum(v.count("") for _, v in attrs) != len(tokens):
            return None  # not in quotes, or lost with a repeated key
        values = []
        for k, v in attrs:
            pieces = re.split("(\\d+)", v)
            values.append((k, tuple(int(tokens[int(p)]) if i % 2 else p for i, p in enumerate(pieces) if i % 2 or p)))
        return name, tuple(values), values

    @staticmethod
    def _filled(values) -> Callable:
        """The attributes of a node from the captures of the last match."""
        if len(values) == 1 and len(values[0][1]) == 1 and isinstance(values[0][1][0], int):
            key, (i,) = values[0]
            return lambda captures: ((key, captures[i] if i < len(captures) else ""),)

        def filled(captures):
            n = len(captures)
            return tuple((k, "".join([p if isinstance(p, str) else captures[p] if p < n else "" for p in parts])) for k, parts in values)

        return filled

    def _plain_node(self, c: ast.Call) -> Callable | None:
        """create, add, open or enter of one plain step; the trigger for what is added is left to the caller."""
        leaf = self._leaf(c.args[0]) if c.args else None
        if leaf is None:
            return self._remembered_node(c) if c.args else None
        name, attrs, values = leaf
        filled = self._filled(values) if values else None
        key = identity(attrs) if attrs and not values else name
        group = (name,) if attrs else None
        fresh = c.name in ("out.create", "out.open")

        def at(run) -> Node:
            top = run.tree.stack[-1]
            newest = top.newest
            if newest is None:
                newest, top.children = {}, []
                top.newest = newest
            if filled is None:
                k, own = key, attrs
            else:
                own = filled(run.captures)
                k = identity(own)
            if group is not None:
                same = newest.get(group)
                newest = newest.setdefault(group, {}) if same is None else same
            if not fresh:
                node = newest.get(k)
                if node is not None:
                    return node
            node = newest[k] = Node(name, own)
            top.children.append(node)
            return node

        return at

    def _remembered_node(self, c: ast.Call) -> Callable | None:
        """The same for a path with captures anywhere: what a path comes to is
        remembered by its captures."""
        template = self._template(c.args[0])
        e = resolve(c.args[0], self.source.defines)
        if not callable(template) or not isinstance(e, ast.Text):
            return None
        tokens = [p[0] for p in _split_template(e.value) if not isinstance(p, str)]
        if not all(t.isdigit() for t in tokens):
            return None
        numbers = [int(t) for t in tokens]
        one = numbers[0] if len(numbers) == 1 else None
        fresh = c.name in ("out.create", "out.open")
        write = c.name in ("out.create", "out.add")
        known: dict = {}

        def at(run) -> Node | None:
            last = run.captures
            n = len(last)
            if one is not None:
                own = last[one] if one < n else ""
            else:
                own = tuple([last[i] if i < n else "" for i in numbers])
            got = known.get(own)
            if got is None:
                path = template(run, last, run.names)
                steps = run.tree.steps(path)
                plain = len(steps) == 1 and not path.startswith(".") and steps[0][0] != "."
                name, attrs = steps[0] if plain else ("", ())
                if len(known) > 20_000:
                    known.clear()
                got = known[own] = (name, attrs, identity(attrs) if attrs else name) if plain else (path,)
            if len(got) == 1:
                return run.tree._target(got[0], fresh) if write else run.tree.walk(run.tree.steps(got[0]), fresh)
            top = run.tree.stack[-1]
            newest = top.newest
            if newest is None:
                newest, top.children = {}, []
                top.newest = newest
            if got[1]:
                newest = newest.setdefault((got[0],), {})
            if not fresh:
                node = newest.get(got[2])
                if node is not None:
                    return node
            node = newest[got[2]] = Node(got[0], got[1])
            top.children.append(node)
            return node

        return at

    def _plain_capture(self, e: ast.Expression) -> int | None:
        """The number of the capture that is all of a template; None if it is anything else."""
        if isinstance(e, ast.Name):
            return None
        if isinstance(e, ast.Text) and (m := re.fullmatch(r"\$([0-9]+)", e.value)):
            return int(m[1])
        return None

    def _action(self, c: ast.Call):
        """A function (run, captures, names) -> what the block does next."""
        args = [self._template(a) for a in c.args]

        def value(i):
            """Of argument i, as a function; None if there is none."""
            if i >= len(args):
                return None
            a = args[i]
            return a if callable(a) else lambda run, captures, names: a

        path, second, third = value(0), value(1), value(2)
        name = c.name
        if name in ("out.create", "out.add", "out.replace"):
            if path is None:
                return None
            write = getattr(Tree, name[4:])
            constant = second is None or not callable(args[1])
            fixed = percent_decode(args[1]) if constant and second else None
            plain = None if constant else self._plain_text(c.args[1])

            at = None if callable(args[0]) else args[0]
            node_at = self._plain_node(c) if name != "out.replace" else None
            if node_at is not None:
                return self._write(name == "out.create", node_at, path, c.args[1] if len(c.args) > 1 else None, fixed, plain, second)

            def step(run, captures, names):
                p = path(run, captures, names) if at is None else at
                write(run.tree, p, fixed if constant else plain(run, captures, names) if plain else percent_decode(second(run, captures, names)))
                if run.queued and (run.single["on_add"] or run.lasting["on_add"]):
                    if any(p.split("/")):
                        run.tree.enter(p)
                        run.fire("on_add")
                        run.tree.leave()

            return step
        if name == "out.add_attribute":
            if third is None:
                return None

            def step(run, captures, names):
                p = path(run, captures, names)
                run.tree.add_attribute(p, second(run, captures, names), third(run, captures, names))
                if run.queued and (run.single["on_add"] or run.lasting["on_add"]):
                    run.tree.enter(p)
                    run.fire("on_add")
                    run.tree.leave()

            return step
        if name == "out.set_root_name":

            def step(run, captures, names):
                run.tree.root.name = path(run, captures, names)

            return step if path else None
        if name in ("out.open", "out.enter"):
            go = getattr(Tree, name[4:])
            node_at = self._plain_node(c) if path else None

            def step(run, captures, names):
                if node_at is not None:
                    run.tree.stack.append(node_at(run))
                else:
                    go(run.tree, path(run, captures, names))
                if run.queued:
                    run.fire("on_add")
                run.to_leave += 1

            return step if path else None
        if name == "out.leave":

            def step(run, captures, names):
                run.fire("on_leave")
                run.tree.leave()
                run.to_leave = max(0, run.to_leave - 1)

            return step
        if name == "do.skip":
            return lambda run, captures, names: _SKIP
        if name == "do.next":
            return lambda run, captures, names: _NEXT
        if name == "do.return":
            return self._return(c)
        if name in ("do.say", "do.warn"):

            def step(run, captures, names):
                run.out.traces.append(f"{name[3:]}: {path(run, captures, names)}")

            return step if path else None
        if name == "do.fail":

            def step(run, captures, names):
                message = path(run, captures, names) if path else "fail"
                run.pos = len(run.text)
                run.out.traces += ["fail invoked", f"fail: {message}"]
                run.failed = message
                run.levels = 1
                return _RETURN

            return step
        if name == "out.clear_queue":

            def step(run, captures, names):
                for kind in ("before", "after", "on_add"):
                    run.single[kind] = []

            return step
        if name.startswith("out.enqueue_"):
            return self._enqueue(c, second, third)
        return None

    def _write(self, creates: bool, node_at, path, text: ast.Expression | None, fixed: str | None, plain, second):
        """create or add where the node is a plain one."""
        number = None if text is None else self._plain_capture(text)

        def step(run, captures, names):
            node = node_at(run)
            if node is None:  # an empty path
                return
            if number is not None:
                last = run.captures
                value = last[number] if number < len(last) else ""
            elif plain is not None:
                value = plain(run, captures, names)
            else:
                value = fixed if fixed is not None or second is None else percent_decode(second(run, captures, names))
            if creates:
                node.text = value
            elif value is not None:
                node.text = value if node.text is None else node.text + value
            if run.queued and (run.single["on_add"] or run.lasting["on_add"]):
                p = path(run, captures, names)
                if any(p.split("/")):
                    run.tree.enter(p)
                    run.fire("on_add")
                    run.tree.leave()

        return step

    @staticmethod
    def _return(c: ast.Call):
        first = c.args[0] if c.args else None

        def step(run, captures, names):
            levels = 1
            if isinstance(first, ast.Number):
                levels = first.value
            elif isinstance(first, ast.Text) and re.fullmatch(r"[+-]?[0-9]+", first.value):
                levels = int(first.value)
            elif isinstance(first, ast.Group | ast.NamedGroup):
                i = first.index if isinstance(first, ast.Group) else names.index(first.name) if first.name in names else -1
                if 0 <= i < len(captures) and re.fullmatch(r"-?[0-9]+", captures[i]):
                    levels = int(captures[i])
            run.levels = max(1, levels)
            return _RETURN

        return step

    def _enqueue(self, c: ast.Call, path, text):
        kind = c.name.removeprefix("out.enqueue_")
        lasting = kind.endswith("_persist")
        kind = kind.removesuffix("_persist")
        pattern = c.args[0] if c.args else None
        if isinstance(pattern, ast.Name):
            pattern = self.source.defines.get(pattern.value)
        if kind not in ("before", "after", "on_add", "on_leave") or not isinstance(pattern, ast.Pattern):
            return None
        try:
            search = re.compile(to_python(f"(?s){pattern.value}")[0]).search
        except (PatternError, re.PatternError):
            return None

        def step(run, captures, names):
            run.queued = True
            queue = run.lasting if lasting else run.single
            queue[kind].append((search, path(run, captures, names) if path else "", text(run, captures, names) if text else None))

        return step

    def run(self, text: str, grammar: str = "input", record: bool = False) -> Outcome:
        if grammar not in self.rules:
            raise RuntimeError(f"unknown: runtime error: Grammar not found: {grammar}")
        if sys.getrecursionlimit() < 8 * MOST_LEVELS:
            sys.setrecursionlimit(8 * MOST_LEVELS)
        collecting = gc.isenabled()
        gc.disable()  # a tree has no cycles, and its many nodes would be visited again and again
        try:
            return Run(self, text, record).entry(grammar)
        finally:
            if collecting:
                gc.enable()


def _ascii_lower(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

# The skip patterns that aren't limited by the search window.
_UNLIMITED = frozenset(
    (
        r"[^\n]*\n", r"[^\n]+\n", r"[^\r\n]*[\r\n]", r"[^\r\n]+[\r\n]", r"[!#][^\r\n]*[\r\n]", r"#[^\r\n]*[\r\n]+",
        r".*\n", r".*?\n", r"\s+", r"\S+", r"\d+", r"\w+", r"[\t ]+", r"[\r\n]+", r"[\r\n]", r"[^\r\n]+", r"[^\r\n]*", r"[^\r\n]",
        r" *[\r\n]+", r"\r?\n", r"(?:\r?\n)+", r"[^\r\n]*\r?\n", r"[^\r\n]+\r?\n", r"[!#][^\r\n]*\r?\n",
        r"#[^\r\n]*(?:\r?\n)+", r" *(?:\r?\n)+", r"\n", r".",
    )
)


def _split_template(t: str) -> list[str | tuple[str]]:
    """Literal parts, and the tokens of captures as 1-tuples; ``\\$`` is a dollar sign."""
    out: list[str | tuple[str]] = []
    at = 0
    for m in re.finditer(r"\\\$|\$([A-Za-z0-9_]*)", t):
        out.append(t[at : m.start()])
        out.append((m[1],) if m[1] else "$")
        at = m.end()
    return [*(p for p in out if p), t[at:]]


@functools.cache
def _index(token: str) -> int:
    """The position that a token names, or -1 for a name."""
    return int(token) if token.isdigit() else -1


def _bytes_before(text: str) -> array:
    """For each character, and for the end, the UTF-8 bytes before it: 8 bytes each."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.ones(len(cp) + 1, dtype=np.int64)
    size[0] = 0
    for least in (0x80, 0x800, 0x10000):
        size[1:] += cp >= least
    out = array("q")
    out.frombytes(np.cumsum(size).tobytes())
    return out


class Run:
    """The state of one text: cursor, captures, triggers and tree."""

    def __init__(self, machine: Machine, text: str, record: bool):
        self.machine = machine
        self.text = text
        self.record = record
        self.pos = 0
        self.tree = Tree(machine.preserve_case, machine.paths)
        self.out = Outcome(self.tree)
        self.window = machine.window
        #: Bytes before each character; None if characters are bytes.
        self.sizes = None if text.isascii() else _bytes_before(text)
        #: Whether the search window holds all of the text, so that it ends nowhere.
        self.within = (len(text) if self.sizes is None else self.sizes[-1]) <= machine.window
        #: Where the last match stands in the text: a pair, or the match itself.
        self.matched: tuple[int, int] | re.Match = (0, 0)
        #: Whether any trigger was ever set.
        self.queued = False
        self.captures: list[str] | tuple[str, ...] = ()
        self.names: list[str | None] = []
        self.single: dict[str, list] = {k: [] for k in ("before", "after", "on_add", "on_leave")}
        self.lasting: dict[str, list] = {k: [] for k in ("before", "after", "on_add", "on_leave")}
        self.to_leave = 0
        self.levels = 0
        self.failed: str | None = None
        self.first_failure: str | None = None
        self.depth = 0

    def reach(self, at: int | None = None) -> int:
        """Where the search window ends: so many bytes on, or the next character's start."""
        at = self.pos if at is None else at
        if self.sizes is None:
            return min(len(self.text), at + self.window)
        return min(len(self.text), bisect_left(self.sizes, self.sizes[at] + self.window, at))

    def bytes_between(self, a: int, b: int) -> int:
        return b - a if self.sizes is None else self.sizes[b] - self.sizes[a]

    def capture(self, token: str) -> str:
        """The last match's ``$N`` or ``$name``."""
        i = _index(token)
        if i < 0:
            if token not in self.names:
                return ""
            i = self.names.index(token)
        return self.captures[i] if i < len(self.captures) else ""

    # --- triggers ---

    def fire(self, kind: str) -> None:
        single, lasting = self.single[kind], self.lasting[kind]
        if not single and not lasting:
            return
        start, end = self.matched if isinstance(self.matched, tuple) else self.matched.span()
        matched = self.text[start:end]
        hit = [i for i, (search, _, _) in enumerate(single) if search(matched)]
        for i in reversed(hit):  # the last entry takes the place of the one that fires
            trigger = single[i]
            last = single.pop()
            if i < len(single):
                single[i] = last
            self._apply(trigger)
        for trigger in list(lasting):
            if trigger[0](matched):
                self._apply(trigger)

    def _apply(self, trigger) -> None:
        _, path, text = trigger
        self.tree.add_at(self.tree.steps(self._raw(path)), None if text is None else self._raw(text))

    def _raw(self, template: str) -> str:
        if "$" not in template:
            return template
        return "".join(p if isinstance(p, str) else self.capture(p[0]) for p in _split_template(template))

    # --- rules ---

    def perform(self, block: _Block, captures, names) -> int:
        """Run a block's actions, then leave what they opened: 0, or how the block ended."""
        outer, self.to_leave = self.to_leave, 0
        result = 0
        for step in block.steps:
            result = step(self, captures, names) or 0
            if result:
                break
        if self.to_leave:
            for _ in range(self.to_leave):
                if self.queued:
                    self.fire("on_leave")
                self.tree.leave()
        self.to_leave = outer
        return result if result >= _NEXT else 0

    def call(self, name: str) -> int:
        """Run another grammar here; the bytes it used.  ``levels`` then holds
        the levels that are still to be left."""
        start = self.pos
        if self.depth == MOST_LEVELS:
            if self.first_failure is None:
                self.first_failure = f"grammar calls nested more than {MOST_LEVELS} levels deep (calling '{name}' at line {line_number(self.text, start)})"
            self.pos = len(self.text)
            self.levels = 0
            return self.bytes_between(start, self.pos)
        self.depth += 1
        self._grammar(name)
        self.depth -= 1
        return self.bytes_between(start, self.pos)

    def _grammar(self, name: str) -> None:
        machine, text = self.machine, self.text
        picked, ahead = machine.picked[name], machine.seen[name]
        self.levels = 0
        returned = False
        while not returned:
            before = self.pos
            seen = text[before : before + ahead]
            rules = picked.get(seen)
            for rule in machine.pick(name, seen) if rules is None else rules:
                fast = rule[4]
                end = self._try(rule) if fast is None else fast(self)
                if end:
                    if self.failed is not None:
                        self.first_failure = self.first_failure if self.first_failure is not None else self.failed
                        self.failed = None
                    if end == _RETURN:
                        returned = True
                    break
            if self.pos == before:
                break
        self.levels = max(0, self.levels - 1) if returned else 0

    def _try(self, rule, log=None) -> int:
        """Try a rule: 0 if the next one is to be tried, else how it ended."""
        kind = rule[0]
        start = self.pos
        if kind == "match" or kind == "when":
            got = rule[1](self)
            if got is None:
                return 0
            end, captures, names = got
            if kind == "match":
                self.matched = start, end
                self.pos = end
            else:
                self.matched = 0, 0
            self.captures, self.names = captures, names
            if self.queued:
                self.fire("before")
            result = self.perform(rule[2], captures, names)
            if result:
                return result
            if log:
                log(rule, captures, names, start)
            if self.queued:
                self.fire("after")
            return _BREAK
        if kind == "skip":
            end = rule[1](self)
            if end is not None and end > start:
                self.pos = end
                return _BREAK
            return 0
        if kind == "grammar":
            used = self.call(rule[1])
            return _RETURN if self.levels else _BREAK if used else 0
        result = self.perform(rule[1], (), [])
        return result or (_BREAK if self.pos > start else 0)

    def entry(self, name: str) -> Outcome:
        out = self.out
        machine, text = self.machine, self.text
        picked, ahead = machine.picked[name], machine.seen[name]
        log = self._log if self.record else None
        length, sizes = len(text), self.sizes
        while True:
            before = self.pos
            returned = False
            seen = text[before : before + ahead]
            rules = picked.get(seen)
            for rule in machine.pick(name, seen) if rules is None else rules:
                end = self._try(rule, log) if log or rule[4] is None else rule[4](self)
                # What a lookahead's block uses, or an action that returns, isn't counted.
                if self.pos != before and rule[0] != "when" and (rule[0] != "action" or end == _BREAK):
                    out.consumed += self.pos - before if sizes is None else sizes[self.pos] - sizes[before]
                if self.failed is not None:
                    out.error, self.failed = self.failed, None
                if end == _RETURN:
                    returned = True
                if end:
                    break
            if returned or self.pos >= length:
                break
            if self.pos == before:
                at = self.bytes_between(0, self.pos)
                self._note("warning", f"no match found in grammar {name}, pos {at}")
                break
        if out.error is None:
            out.error = self.first_failure
        if out.error is None and self.pos < len(self.text):
            rest = debug_string(self.text[self.pos : self.pos + 40])
            out.error = f"grammar '{name}' stopped at line {line_number(self.text, self.pos)} before the end of the input: {rest}"
        return out

    def _note(self, severity: str, message: str) -> None:
        self.out.traces.append(message)
        self.out.diagnostics.append((severity, message))

    def _log(self, rule, captures, names, start: int) -> None:
        if rule[0] == "when":
            self._note("info", "when triggered")
            return
        block = rule[2]
        for c in block.calls:
            args = c.args
            if block.has_groups:
                args = tuple(ast.Text(self.machine._template(a)(self, captures, names)) if isinstance(a, ast.Group | ast.NamedGroup) else a for a in args)
            self.out.actions.append((c.name, args))
        if self.captures:
            self.out.captures.append(list(self.captures))
            self.out.capture_names.append([n or "" for n in self.names])
        self._note("info", f"match consumed {self.bytes_between(start, self.pos)} chars")
