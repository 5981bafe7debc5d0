"""Parsing of streams: a stateless map, so that no state store is needed."""

from .parse import parse_stream, read_text_stream, stream_nodes

__all__ = ["parse_stream", "read_text_stream", "stream_nodes"]
