"""Where outputs go."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ParsingFailed
from ..functions.writers import format_name, write_run, write_tree
from ..operators.kernel import Outcome
from ..operators.parse import parse
from ..plans.grammar import Grammar


def write_outputs(df: DataFrame, grammar: Grammar, path: str, fmt: str = "json", start: str = "input", text_col: str = "text", mode: str = "FAILFAST", overwrite: bool = False) -> None:
    """Parse and write the outputs as text files, one document behind another.
    Spark's committer leaves no partial files behind."""
    out = parse(df, grammar, text_col, fmt, start, ("output",), mode).select("output").where("output is not null")
    out.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_file(text: str, path: str) -> None:
    """Write one file on the driver; on an error nothing is left of it."""
    part = f"{path}.{os.getpid()}.part"
    try:
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(part, path)
    except OSError:
        if os.path.exists(part):
            os.remove(part)
        raise


def serialize_tree(run: Outcome, fmt: str) -> str:
    """The tree alone; a run that failed is an error."""
    if run.error is not None:
        raise ParsingFailed(run.error)
    return write_tree(run.tree.root, format_name(fmt))


def serialize_execution(run: Outcome, fmt: str) -> str:
    """Everything about the run; its error is a part of that."""
    return write_run(run, format_name(fmt))


def malformed(df: DataFrame, grammar: Grammar, text_col: str = "text", start: str = "input") -> DataFrame:
    """The rows that don't parse, with their error."""
    return parse(df, grammar, text_col, "none", start, ("error",)).where(F.col("error").isNotNull())
