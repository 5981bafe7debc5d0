"""Grammars as SQL functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ParsingFailed
from ..functions.writers import format_name, write_tree
from ..plans.grammar import Grammar
from .parse import _NODE_COLUMNS, NODES, _node_rows


def register_function(spark: SparkSession, name: str, grammar: Grammar, fmt: str = "json", start: str = "input", strict: bool = False) -> None:
    """``name(text)`` gives a text's output; null for a null text, and for one
    that doesn't parse unless ``strict``, which fails the query."""
    fmt = format_name(fmt)

    def convert(texts: pa.Array) -> pa.Array:
        machine = grammar.machine()
        out: list[str | None] = []
        for t in texts.to_pylist():
            run = None if t is None else machine.run(t, start)
            try:
                if run is not None and run.error is not None:
                    raise ParsingFailed(run.error)
                out.append(run and write_tree(run.tree.root, fmt))
            except ParsingFailed:
                if strict:
                    raise
                out.append(None)
        return pa.array(out, pa.string())

    spark.udf.register(name, F.arrow_udf(convert, "string"))


def register_nodes_function(spark: SparkSession, name: str, grammar: Grammar, start: str = "input") -> None:
    """``name(text)`` gives the node rows of a text as an array, in batches of
    texts: ``SELECT d.id, n.* FROM docs d LATERAL VIEW inline(name(d.text)) n``.
    A null text gives null, of which ``inline`` makes no rows."""
    kind = pa.list_(pa.struct([(c, t) for c, (t, _) in _NODE_COLUMNS.items()]))
    names = list(_NODE_COLUMNS)

    def convert(texts: pa.Array) -> pa.Array:
        machine = grammar.machine()
        rows = [None if t is None else [dict(zip(names, row, strict=True)) for row in _node_rows(machine.run(t, start))] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    spark.udf.register(name, F.arrow_udf(convert, f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(NODES))}>>"))


def register_table_function(spark: SparkSession, name: str, grammar: Grammar, start: str = "input") -> None:
    """``name(text)`` gives the node rows of a text, for lateral joins:
    ``SELECT d.id, n.* FROM docs d, LATERAL name(d.text) n``.  Spark joins so
    with functions of single rows only, for which pickled rows take a fraction
    of the time of Arrow's tables; :func:`register_nodes_function` runs in batches."""

    class Nodes:
        def eval(self, text: str | None):
            if text is not None:
                yield from ((*row[:-1], [(a["key"], a["value"]) for a in row[-1]]) for row in _node_rows(grammar.machine().run(text, start)))

    spark.udtf.register(name, F.udtf(Nodes, returnType=NODES, useArrow=False))
