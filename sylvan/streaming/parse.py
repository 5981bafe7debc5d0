"""Parsing of streams: a stateless map, so that no state store is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import nodes, parse
from ..plans.grammar import Grammar


def read_text_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(value): a row for each new file below ``path``, whole."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse_stream(stream: DataFrame, grammar: Grammar, text_col: str = "value", fmt: str = "json", start: str = "input", columns: tuple[str, ...] = ("consumed", "error", "output"), mode: str = "PERMISSIVE") -> DataFrame:
    """As for a table; watermarks and windows on other columns go on working."""
    return parse(stream, grammar, text_col, fmt, start, columns, mode)


def stream_nodes(stream: DataFrame, grammar: Grammar, keys: list[str], path: str, checkpoint: str, text_col: str = "value", start: str = "input", mode: str = "PERMISSIVE", available_now: bool = True) -> StreamingQuery:
    """Append the node rows of a stream to Parquet files."""
    writer = nodes(stream, grammar, keys, text_col, start, mode).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
