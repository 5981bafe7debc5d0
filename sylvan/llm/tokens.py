"""Token counts (operator 10): batch encoding in Arrow functions that returns
lengths only.

Batches are balanced by bytes, not rows, and long texts are split where no
token can cross: at a single space between two ASCII letters or digits.  The
vocabulary is one of the public files; its path is a parameter.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts

#: Bytes after which a long text is split at the next safe boundary.
SPLIT_BYTES = 64 << 10
_SAFE = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def safe_pieces(text: bytes, most: int = SPLIT_BYTES) -> list[bytes]:
    """Cut a text at single spaces between ASCII letters or digits, at least
    ``most`` bytes apart; the space itself is dropped, as the model writes the
    same mark before the first word of a piece.  A text without such a place
    stays whole."""
    out, start = [], 0
    while len(text) - start > most:
        m = _SAFE.search(text, start + most)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.end()
    out.append(text[start:])
    return out


class PieceCounter:
    """Counts tokens with a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Whether a piece may have a word's start inside; then nothing is split.
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def lengths(self, texts: list[bytes]) -> list[int]:
        parts, owner = [], []
        for i, t in enumerate(texts):
            for p in safe_pieces(t) if self.splits and len(t) > SPLIT_BYTES else [t]:
                parts.append(p.decode("utf-8", "replace"))
                owner.append(i)
        out = [0] * len(texts)
        for i, ids in zip(owner, self.encode(parts), strict=True):
            out[i] += len(ids)
        return out


class JsonCounter:
    """Counts tokens with a ``tokenizers`` file; texts are never split."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def lengths(self, texts: list[bytes]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]


def counter(path: str) -> PieceCounter | JsonCounter:
    return JsonCounter(path) if path.endswith(".json") else PieceCounter(path)


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens); a null id is handed on;
    repeated rows give repeated results; other columns are not read.
    """

    def lengths(texts: list[bytes | None], count) -> list[pa.Array]:
        whole = [t or b"" for t in texts]
        return [pa.array([len(t) for t in whole], pa.int64()), pa.array(count.lengths(whole), pa.int64())]

    taken = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    n = fresh(taken, "n_tokens")
    got = map_texts(taken, text_col, [id_col], f"n_bytes bigint, {n} bigint", lengths, lambda: counter(model_path))
    return got.withColumn("over_limit", F.col(n) > limit)
