"""Grammars that need no kernel: one rule per line, lowered to Spark's own
expressions.

A grammar is *linewise* if every statement is a ``match`` whose last field is
one line end, no earlier field can match a line end, and whose actions create
nodes at the root with constant names.  Then a document is split into lines,
each line is classified by one ``CASE`` of fused patterns, and its captures
become node rows, all in one projection without a shuffle.  Documents that the
lowering can't reproduce exactly (a line that no rule takes, that is longer than
the search window, that has a carriage return, or a last line without an end) go to
the kernel instead.  Where a test isn't sure, the grammar counts as general.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans import ast
from ..plans.analysis import flatten, resolve
from ..plans.dialect import PatternError, to_java, to_python
from ..plans.grammar import Grammar
from .kernel import Machine, _split_template
from .parse import NODES, node_columns
from .parse import nodes as kernel_nodes
from .tree import parse_path

# Patterns that consume exactly one line end where there is no carriage return.
_ANY_LINE = (r"[^\r\n]*", r"[^\n]*", r".*")
_LINE_ENDS = (r"[\r\n]", r"[\n]", r"\n", r"\r?\n", r"[\r]?\n")


@dataclass(frozen=True)
class _Create:
    name: str
    text: str | None
    attrs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class LineRule:
    """A fused pattern for a line with its end, and the nodes it creates.
    A rule that is one field for any line needs no pattern at all."""

    pattern: str
    creates: tuple[_Create, ...]
    any_line: bool = False

    def takes(self, line: Column) -> Column:
        return F.lit(True) if self.any_line else F.concat(line, F.lit("\n")).rlike(self.pattern)

    def capture(self, line: Column, i: int) -> Column:
        if self.any_line:
            return line if i == 0 else F.lit("\n")
        return F.regexp_extract(F.concat(line, F.lit("\n")), self.pattern, i + 1)


def _can_match_line_end(pattern: str) -> bool:
    """Whether some item of a pattern takes a line feed; yes if unsure."""
    try:
        tree = re._parser.parse(to_python(pattern, ascii_only=True)[0])  # a line end is in ASCII
    except (PatternError, re.PatternError):
        return True

    def item(op, arg) -> bool:
        name = str(op)
        if name == "LITERAL":
            return arg == 10
        if name == "NOT_LITERAL":
            return arg != 10
        if name == "ANY":
            return bool(tree.state.flags & re.DOTALL)
        if name == "IN":
            return _set_has_line_end(arg)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            return walk(arg[2])
        if name == "SUBPATTERN":
            return bool(arg[1] & (re.DOTALL | re.VERBOSE)) or walk(arg[3])
        if name == "BRANCH":
            return any(walk(b) for b in arg[1])
        return name != "AT"

    def walk(items) -> bool:
        return any(item(op, arg) for op, arg in items)

    return walk(tree)


def _has_anchor(pattern: str) -> bool:
    """Whether a pattern looks at what surrounds the cursor; yes if unsure."""
    try:
        source, sliced = to_python(pattern, ascii_only=True)
    except PatternError:
        return True
    return sliced or r"\Z" in source or "$" in source.replace(r"\$", "").replace("[$", "[")


def _set_has_line_end(items) -> bool:
    negated = bool(items) and str(items[0][0]) == "NEGATE"
    inside = False
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            inside |= arg == 10
        elif name == "RANGE":
            inside |= arg[0] <= 10 <= arg[1]
        elif name == "CATEGORY":
            inside |= bool(re.match({"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}[str(arg)], "\n"))
    return inside != negated


def line_rules(grammar: Grammar, start: str = "input") -> list[LineRule] | None:
    """The rules of a linewise grammar in order, or None if it isn't one."""
    defines = grammar.source.defines
    out = []
    for s in flatten(grammar.source, start):
        if not isinstance(s, ast.Match) or not s.consumes:
            return None
        creates = []
        for c in s.actions:
            made = _create(c, grammar)
            if made is None:
                return None
            creates.append(made)
        for fields in s.alternatives:
            resolved = [resolve(e, defines) for e in fields]
            parts = [Machine._as_pattern(e) for e in resolved]
            if None in parts or not isinstance(resolved[-1], ast.Pattern) or resolved[-1].value not in _LINE_ENDS:
                return None
            if any(_can_match_line_end(p) or _has_anchor(p) for p in parts[:-1]):
                return None
            flags = "(?Udiu)" if s.ignore_case else "(?Ud)"
            try:
                out.append(LineRule(f"{flags}^" + "".join(f"({to_java(p, s.ignore_case)})" for p in parts), tuple(creates), parts[:-1] in ([p] for p in _ANY_LINE)))
            except PatternError:
                return None
    return out or None


def _create(c: ast.Call, grammar: Grammar) -> _Create | None:
    """A node with a constant name and templates for its text and attributes."""
    if c.name != "out.create" or not 1 <= len(c.args) <= 2:
        return None
    path, *rest = (resolve(a, grammar.source.defines) for a in c.args)
    if not isinstance(path, ast.Text) or "/" in path.value or path.value.startswith("."):
        return None
    head, has_query, query = path.value.partition("?")
    if "$" in head or "%" in path.value or "\\" in path.value:
        return None
    attrs = []
    for pair in query.split("&") if has_query else ():
        m = re.fullmatch(r'([^="$]+)="([^"]*)"', pair)
        if not m:
            return None
        attrs.append((m[1], m[2]))
    steps = parse_path(head + ("?" + "&".join(f'{k}="{i}"' for i, (k, _) in enumerate(attrs)) if attrs else ""), grammar.preserve_case)
    if len(steps) != 1 or steps[0][0] in ("", ".") or len(steps[0][1]) != len(attrs):
        return None
    text = None
    if rest:
        e = rest[0]
        if isinstance(e, ast.Group):
            text = f"${e.index}"
        elif isinstance(e, ast.Text) and "%" not in e.value and "\\" not in e.value:
            text = e.value
        else:
            return None
    if any(not t.isdigit() for value in (text or "", *(v for _, v in attrs)) for t in re.findall(r"\$(\w+)", value)):
        return None
    return _Create(steps[0][0], text, tuple((k, attrs[int(i)][1]) for k, i in steps[0][1]))


def _filled(template: str, line: Column, rule: LineRule) -> Column:
    """A template with the captures of a line."""
    n = re.compile(to_python(rule.pattern.partition("^")[2], ascii_only=True)[0]).groups
    parts = []
    for p in _split_template(template):
        if isinstance(p, str):
            parts += [F.lit(p)] if p else []
        elif int(p[0]) < n:
            parts.append(rule.capture(line, int(p[0])))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


def nodes(df: DataFrame, grammar: Grammar, keys: list[str], text_col: str = "text", start: str = "input", lower: str = "auto", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The node table of :func:`sylvan.operators.parse.nodes`, with Spark's own
    expressions for the documents of a linewise grammar where they can be.

    ``lower="auto"`` does so where that is the faster way: for grammars that
    take any line and need no pattern (some 1.7 times as fast as the kernel on
    25 MB of prose; Java's Unicode patterns are half as fast as the kernel).
    ``"always"`` does so for all linewise grammars, and keeps their documents
    out of Python; ``"never"`` is the kernel.

    A document's lines are classified in one pass over an array; the order of
    its nodes, those of one name together, comes from a sort of that array;
    then one row per node is generated, and captures are taken in that row.
    """
    if lower not in ("auto", "always", "never"):
        raise ValueError(f"unknown way of lowering: {lower!r}")
    rules = line_rules(grammar, start) if lower != "never" else None
    if rules is None or (lower == "auto" and not (rules[0].any_line and len(rules[0].creates) == 1)):
        return kernel_nodes(df, grammar, keys, text_col, start, columns=columns)
    if clash := {k.lower() for k in keys} & set(StructType.fromDDL(NODES).fieldNames()):
        raise ValueError(f"keys can't be named like columns of the result: {sorted(clash)}")
    text = F.col("__text")
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").alias("__text"))
    fits = text.endswith("\n") & ~text.contains("\r")
    lines = F.split(F.expr("substring(__text, 1, length(__text) - 1)"), "\n")
    rules = rules[: next((i for i, r in enumerate(rules) if r.any_line), len(rules)) + 1]  # what stands behind is never reached

    def classify(line: Column) -> Column:
        """The number of the first rule that takes a line, or -1."""
        if rules[0].any_line:
            return F.lit(0)
        out = F.when(rules[0].takes(line), 0)
        for i, r in enumerate(rules[1:], start=1):
            out = out.otherwise(i) if r.any_line else out.when(r.takes(line), i)
        return out if rules[-1].any_line else out.otherwise(-1)

    short = (F.octet_length(text) <= grammar.window) | F.forall(lines, lambda x: F.octet_length(x) < grammar.window)
    lowered = F.coalesce(fits & short, F.lit(False))
    flagged = picked.withColumn("__lines", F.when(lowered, lines))
    simple = len(rules) == 1 and rules[0].any_line and len(rules[0].creates) == 1
    if not simple:
        flagged = flagged.withColumn("__rules", F.transform("__lines", classify))
    native = F.col("__lines").isNotNull() & (F.lit(True) if rules[-1].any_line else ~F.array_contains("__rules", -1))
    general = kernel_nodes(flagged.where(F.col("__text").isNotNull() & ~native), grammar, keys, "__text", start, columns=columns)

    flat = [(r, c) for r in rules for c in r.creates]  # each create has its place in this list
    names = list(dict.fromkeys(c.name for _, c in flat))
    if simple:
        native_rows = flagged.where(native).select(*[f"`{k}`" for k in keys], F.posexplode(F.concat(F.array(F.lit("")), "__lines")).alias("__at", "__line")).withColumn("__c", F.lit(0))
    else:
        first = [sum(len(r.creates) for r in rules[:i]) for i in range(len(rules))]

        def created(i: Column) -> Column:
            """The creates of the line with number i."""
            rule, line = F.get("__rules", i), F.get("__lines", i)
            each = [F.array(*[F.struct(F.lit(at + j).alias("c"), line.alias("line")) for j in range(len(r.creates))]) for at, r in zip(first, rules, strict=True)]
            out = each[0]
            for k, e in enumerate(each[1:], start=1):
                out = F.when(rule == k, e).otherwise(out)
            return out

        made = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__lines") - 1), created))
        rows = flagged.where(native).withColumn("__made", made)
        if len(names) > 1:
            name_of = F.array(*[F.lit(names.index(c.name)) for _, c in flat])
            rows = rows.withColumn("__names", F.transform("__made", lambda m: F.get(name_of, m["c"])))
            begins = F.array(*[F.array_position("__names", i) for i in range(len(names))])
            rows = rows.withColumn("__begins", begins)
            keyed = F.transform("__made", lambda m, i: F.struct(F.get(F.col("__begins"), F.get(F.col("__names"), i)).alias("f"), i.alias("i"), m["c"].alias("c"), m["line"].alias("line")))
            rows = rows.withColumn("__made", F.array_sort(keyed))
        root = F.expr("array(named_struct('c', 0, 'line', ''))")
        body = F.transform("__made", lambda m: F.struct(m["c"].alias("c"), m["line"].alias("line"))) if len(names) > 1 else F.col("__made")
        native_rows = rows.select(*[f"`{k}`" for k in keys], F.posexplode(F.concat(root, body)).alias("__at", "__m"))
        native_rows = native_rows.select(*[f"`{k}`" for k in keys], "__at", F.col("__m.line").alias("__line"), F.col("__m.c").alias("__c"))

    at, line = F.col("__at"), F.col("__line")
    is_root = at == 0
    no_attrs = F.expr("cast(array() as array<struct<key:string,value:string>>)")

    def chosen(of, otherwise: Column) -> Column:
        """What ``of`` gives for the create of the row; something else for the root."""
        out = F.when(is_root, otherwise)
        for i, (r, c) in enumerate(flat):
            value = of(r, c)
            out = out.otherwise(value) if i == len(flat) - 1 else out.when(F.col("__c") == i, value)
        return out

    name = chosen(lambda r, c: F.lit(c.name), F.lit(""))
    made = native_rows.select(
        *[f"`{k}`" for k in keys],
        at.cast("bigint").alias("node_id"),
        F.when(~is_root, F.lit(0)).cast("bigint").alias("parent_id"),
        F.when(is_root, 0).otherwise(1).cast("bigint").alias("depth"),
        F.greatest(at - 1, F.lit(0)).cast("bigint").alias("ord"),
        name.alias("name"),
        chosen(lambda r, c: F.lit("/" + c.name), F.lit("")).alias("path"),
        chosen(lambda r, c: F.nullif(_filled(c.text, line, r), F.lit("")) if c.text is not None else F.lit(None).cast("string"), F.lit(None).cast("string")).alias("text"),
        chosen(lambda r, c: F.array(*[F.struct(F.lit(k).alias("key"), _filled(v, line, r).alias("value")) for k, v in c.attrs]) if c.attrs else no_attrs, no_attrs).alias("attrs"),
    )
    return made.select(*[f"`{c}`" for c in (*keys, *node_columns(columns))]).unionByName(general)
