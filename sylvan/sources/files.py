"""Where texts and grammars come from."""

from __future__ import annotations

import codecs
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grammar import Grammar


def require_utf8(encoding: str) -> None:
    """Files are UTF-8; any other codec is a ValueError."""
    if codecs.lookup(encoding).name != "utf-8":
        raise ValueError(f"only UTF-8 is supported, not '{encoding}'")


def read_texts(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8", strict: bool = True) -> DataFrame:
    """(file, text): a row for each file, whole.  With ``strict``, a file that
    isn't UTF-8 fails the job when it is read; else its bytes are replaced."""
    require_utf8(encoding)
    files = spark.read.format("binaryFile").load(paths)
    check = F.validate_utf8 if strict else F.make_valid_utf8
    return files.select(F.col("path").alias("file"), check(F.col("content").cast("string")).alias("text"))


def text_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text) from texts at hand."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def read_stdin(spark: SparkSession) -> DataFrame:
    """One row with all of the driver's standard input."""
    return text_frame(spark, [sys.stdin.buffer.read().decode("utf-8")])


def read_file(path: str) -> str:
    """A UTF-8 file on the driver, line ends as they are."""
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise OSError(f"{path}: {e}") from None


def compile_file(path: str, encoding: str = "utf-8", *, preserve_case: bool = False, search_window: int | None = None) -> Grammar:
    require_utf8(encoding)
    return Grammar.compile(read_file(path), preserve_case=preserve_case, search_window=search_window)
