"""Parsing of text columns: one row is one document.

All of these are lazy and narrow (no shuffle): a kernel runs in Arrow batches
on the executors and yields only what was asked for, so choose the function,
or the columns, by what you need.  Filter before :func:`nodes`, not after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..errors import ParsingFailed
from ..functions.writers import format_name, write_run, write_tree
from ..plans.grammar import Grammar
from .kernel import Outcome

MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")
#: Rows that one Arrow batch of nodes holds before it is handed on.
BATCH_ROWS = 20_000
#: Characters of outputs that one Arrow batch holds before it is handed on, unless one document has more.
BATCH_CHARS = 1 << 22

_ATTRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_DIAGNOSTICS = pa.list_(pa.struct([("severity", pa.string()), ("message", pa.string())]))

#: What :func:`parse` can return for a document.
OUTPUTS = {
    "consumed": ("bigint", pa.int64()),
    "error": ("string", pa.string()),
    "traces": ("array<string>", pa.list_(pa.string())),
    "diagnostics": ("array<struct<severity:string,message:string>>", _DIAGNOSTICS),
    "output": ("string", pa.string()),
    "execution": ("string", pa.string()),
}


def _mode(mode: str) -> str:
    if mode.upper() not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    return mode.upper()


def _check(grammar: Grammar, start: str) -> None:
    if start not in grammar.source.grammars:
        raise ValueError(f"Grammar not found: {start}")


def _document(grammar: Grammar, start: str, text: str, fmt: str, wanted: tuple[str, ...], mode: str) -> dict:
    """The wanted outputs of one document."""
    run = grammar.machine().run(text, start, record=any(w in wanted for w in ("traces", "diagnostics", "execution")))
    error, output = run.error, None
    if error is None and "output" in wanted:
        try:
            output = write_tree(run.tree.root, fmt)
        except ParsingFailed as e:
            error = str(e)
    if error is not None and mode == "FAILFAST":
        raise ParsingFailed(error)
    out: dict = {}
    for w in wanted:
        if w == "consumed":
            out[w] = run.consumed
        elif w == "error":
            out[w] = error
        elif w == "traces":
            out[w] = run.traces
        elif w == "diagnostics":
            out[w] = [{"severity": s, "message": m} for s, m in run.diagnostics]
        elif w == "output":
            out[w] = output
        else:
            out[w] = write_run(run, fmt)
    return out


def _size(outputs: dict) -> int:
    """About the characters that a document's outputs take."""
    return sum(len(v) * (1 if isinstance(v, str) else 50) for v in outputs.values() if isinstance(v, str | list))


def parse_column(grammar: Grammar, text: Column | str, fmt: str = "json", start: str = "input", columns: tuple[str, ...] = ("consumed", "error", "output"), mode: str = "PERMISSIVE") -> Column:
    """A struct of the wanted outputs for a text column; null for a null text.

    Only PERMISSIVE and FAILFAST make sense for a column.
    """
    fmt, mode = format_name(fmt), _mode(mode)
    _check(grammar, start)
    ddl = "struct<" + ",".join(f"{c}:{OUTPUTS[c][0]}" for c in columns) + ">"
    kind = pa.struct([(c, OUTPUTS[c][1]) for c in columns])

    @F.arrow_udf(ddl)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows, held = [], 0
            for t in texts:
                text = t.as_py()
                got = None if text is None else _document(grammar, start, text, fmt, columns, mode)
                rows.append(got)
                held += got is not None and _size(got)
                # An array of results may be shorter than that of the texts.
                if held >= BATCH_CHARS:
                    yield pa.array(rows, kind)
                    rows, held = [], 0
            if rows:
                yield pa.array(rows, kind)

    return run(text if isinstance(text, Column) else F.col(text))


def parse(df: DataFrame, grammar: Grammar, text_col: str = "text", fmt: str = "json", start: str = "input", columns: tuple[str, ...] = ("consumed", "error", "output"), mode: str = "PERMISSIVE") -> DataFrame:
    """``df`` with a column for each wanted output (see :data:`OUTPUTS`).

    PERMISSIVE puts what went wrong into ``error`` and leaves ``output`` null,
    DROPMALFORMED drops such rows, FAILFAST raises.  A null text gives nulls.
    An existing column with an output's name is replaced.  A filter on other
    columns that stands behind this still reaches the scan.
    """
    mode = _mode(mode)
    inner = tuple(dict.fromkeys((*columns, "error"))) if mode == "DROPMALFORMED" else columns
    holder = "__parsed"
    out = df.withColumn(holder, parse_column(grammar, F.col(f"`{text_col}`"), fmt, start, inner, mode if mode == "FAILFAST" else "PERMISSIVE"))
    if mode == "DROPMALFORMED":
        out = out.where(F.col(holder).isNotNull() & F.col(f"{holder}.error").isNull())
    taken = {c.lower() for c in columns}
    return out.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken], *[F.col(f"{holder}.{c}").alias(c) for c in columns])


def _rows_of(df: DataFrame, grammar: Grammar, keys: list[str], text_col: str, start: str, mode: str, record: bool, ddl: str, kinds: list[pa.DataType], each) -> DataFrame:
    """Rows of each document behind its keys, in batches of a bounded number."""
    mode = _mode(mode)
    _check(grammar, start)
    extra = StructType.fromDDL(ddl)
    if clash := {k.lower() for k in keys} & {f.name for f in extra.fields}:
        raise ValueError(f"keys can't be named like columns of the result: {sorted(clash)}")
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").alias("__text"))
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in picked.schema.fields[:-1]), *extra.fields])
    k = len(keys)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar.machine()
        for batch in batches:
            of: list[int] = []
            columns: list[list] = [[] for _ in kinds]

            def flush(batch=batch):
                nonlocal of, columns
                at = pa.array(of, pa.int64())
                got = pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(k)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)
                of, columns = [], [[] for _ in kinds]
                return got

            for i in range(batch.num_rows):
                result = row = None  # frees a tree before the next one is built
                text = batch.column(k)[i].as_py()
                if text is None:
                    continue
                result = machine.run(text, start, record=record)
                if result.error is not None and mode != "PERMISSIVE":
                    if mode == "FAILFAST":
                        raise ParsingFailed(result.error)
                    continue
                for row in each(result):
                    of.append(i)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    if len(of) >= BATCH_ROWS:
                        yield flush()
            if of:
                yield flush()

    return picked.mapInArrow(run, schema)


NODES = "node_id bigint, parent_id bigint, depth bigint, ord bigint, name string, path string, text string, attrs array<struct<key:string,value:string>>"
#: Each column of a node row: its Arrow type, and its value from (id, parent, depth, place, node, path).
_NODE_COLUMNS = {
    "node_id": (pa.int64(), lambda x: x[0]),
    "parent_id": (pa.int64(), lambda x: x[1]),
    "depth": (pa.int64(), lambda x: x[2]),
    "ord": (pa.int64(), lambda x: x[3]),
    "name": (pa.string(), lambda x: x[4].name),
    "path": (pa.string(), lambda x: x[5]),
    "text": (pa.string(), lambda x: x[4].text or None),
    "attrs": (_ATTRS, lambda x: [{"key": a, "value": b} for a, b in x[4].all_attrs()]),
}


def _node_rows(r: Outcome):
    for node_id, parent, depth, place, node, path in r.tree.breadth_first():
        yield node_id, parent, depth, place, node.name, path, node.text or None, [{"key": a, "value": b} for a, b in node.all_attrs()]


def node_columns(columns: tuple[str, ...] | None) -> tuple[str, ...]:
    """The columns of :data:`NODES` that are wanted; all by default."""
    if columns is None:
        return tuple(_NODE_COLUMNS)
    if odd := [c for c in columns if c not in _NODE_COLUMNS]:
        raise ValueError(f"no such columns: {odd}")
    return tuple(dict.fromkeys(columns))


def nodes(
    df: DataFrame, grammar: Grammar, keys: list[str], text_col: str = "text", start: str = "input", mode: str = "PERMISSIVE", columns: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per node of each document's tree: ``keys``, then :data:`NODES`
    or those of its columns that are wanted, as no others are made then.

    Ids go breadth first from the root, 0; ``ord`` is the place among the
    siblings, those of one name being together; ``path`` joins the names from
    the root down.  In PERMISSIVE mode a document with an error gives the nodes
    that were built until then.  A null text gives no rows.
    """
    wanted = node_columns(columns)
    if wanted == tuple(_NODE_COLUMNS):
        ddl, each = NODES, _node_rows
    else:
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (StructType.fromDDL(NODES)[c] for c in wanted))
        values = [_NODE_COLUMNS[c][1] for c in wanted]
        paths = "path" in wanted

        def each(r: Outcome):
            for x in r.tree.breadth_first(paths):
                yield tuple(f(x) for f in values)

    return _rows_of(df, grammar, keys, text_col, start, mode, False, ddl, [_NODE_COLUMNS[c][0] for c in wanted], each)


def actions(df: DataFrame, grammar: Grammar, keys: list[str], text_col: str = "text", start: str = "input", mode: str = "PERMISSIVE") -> DataFrame:
    """The calls that matches of the entry grammar made: keys, seq, name, args."""

    def each(r: Outcome):
        from ..functions.writers import _argument

        for i, (name, args) in enumerate(r.actions):
            yield i, name, [str(_argument(a, True)) for a in args]

    return _rows_of(df, grammar, keys, text_col, start, mode, True, "seq bigint, name string, args array<string>", [pa.int64(), pa.string(), pa.list_(pa.string())], each)


def captures(df: DataFrame, grammar: Grammar, keys: list[str], text_col: str = "text", start: str = "input", mode: str = "PERMISSIVE") -> DataFrame:
    """The captures of the entry grammar's matches: keys, match_seq, idx, name, value."""

    def each(r: Outcome):
        for i, (values, names) in enumerate(zip(r.captures, r.capture_names, strict=True)):
            for j, value in enumerate(values):
                yield i, j, (names[j] if j < len(names) else "") or None, value

    return _rows_of(df, grammar, keys, text_col, start, mode, True, "match_seq bigint, idx bigint, name string, value string", [pa.int64(), pa.int64(), pa.string(), pa.string()], each)


def attribute(key: str, attrs: Column | str = "attrs") -> Column:
    """An attribute's value from a node table; null if the node has none."""
    attrs = attrs if isinstance(attrs, Column) else F.col(attrs)
    return F.element_at(F.map_from_entries(attrs), F.lit(key))


def variant(output: Column | str = "output") -> Column:
    """JSON output as a VARIANT, for path access to trees of any shape."""
    return F.parse_json(output)
