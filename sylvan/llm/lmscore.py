"""Language-model scoring (operator 3): cross-entropy difference.

A target and a background model are bigram models over one vocabulary, the
tokens of a public byte-level BPE.  The background is the whole corpus, the
target its documents with a label of 1.  Both are counted over whole tables and
exactly: each pair of neighbouring tokens has a row of its own in a written
table, which grows with the corpus and is never collected.  Only the counts of
single tokens, one row for each of the vocabulary, go to the driver.

The models are matched: the background's counts are scaled to the target's
number of tokens, so that smoothing weighs the same in both.  No document is
scored by a model that has seen it: its own counts are taken off first.  A
document's score is the mean over its tokens of the difference of their losses:
the lower, the more it looks like the target.

Texts are encoded once and written as blocks of about ``BLOCK_TOKENS`` tokens.
Each block adds up its own pairs, a grouped sum adds up the blocks, and each
block gets back what the others have of its pairs; pairs that no other block
has stay where they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import map_texts, materialize, small_side
from .packing import ByteBpe

#: Tokens of a block of documents, unless one document alone is longer; also
#: the pairs that a task adds up or scores at once.
BLOCK_TOKENS = 3 << 20
#: How much the unigram weighs against the counts of a context.
PSEUDO = 5.0
#: Keys from here on are pairs, those below are single tokens.
_PAIRS = 1 << 32


def pair_keys(ids: np.ndarray) -> np.ndarray:
    """The key of each pair of neighbouring tokens; no two pairs share one."""
    a = ids.astype(np.int64)
    return ((a[:-1] + 1) << 32) | a[1:]


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def token_blocks(df: DataFrame, vocabulary: int) -> DataFrame:
    """``df`` (id, tokens, target) with the block of each row: consecutive rows
    of a task with about BLOCK_TOKENS tokens.  To be written, as the blocks of
    another run may differ."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL("block bigint").fields])
    names, size = schema.fieldNames(), np.dtype(_width(vocabulary)).itemsize

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            at = np.zeros(b.num_rows, dtype=np.int64)
            for i, tokens in enumerate(b.column(1)):
                n = tokens.as_buffer().size // size
                if filled and filled + n > BLOCK_TOKENS:
                    block, filled = block + 1, 0
                filled += n
                at[i] = block
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=names)

    return df.mapInArrow(assign, schema)


def merged(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts, a row for each array."""
    out, at = np.unique(keys, return_inverse=True)
    sums = np.empty((len(counts), len(out)), dtype=np.int64)
    for row, c in zip(sums, counts, strict=True):
        row[:] = np.bincount(at, weights=c, minlength=len(out))
    return out, sums


def pairs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a text, and how often it has each."""
    parts = [np.unique(pair_keys(ids[i : i + BLOCK_TOKENS + 1]), return_counts=True) for i in range(0, max(1, len(ids) - 1), BLOCK_TOKENS)]
    keys, n = parts[0]
    if len(parts) > 1:
        keys, sums = merged(np.concatenate([k for k, _ in parts]), [np.concatenate([n for _, n in parts])])
        n = sums[0]
    return keys, n.astype(np.int32)


def _of_block(pairs: list[tuple[np.ndarray, np.ndarray]], is_target: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of several texts, and how often the target's and all of them have each."""
    n = np.concatenate([n for _, n in pairs])
    return merged(np.concatenate([k for k, _ in pairs]), [n * np.repeat(is_target, [len(k) for k, _ in pairs]), n])


def block_counts(blocks: DataFrame, vocabulary: int) -> DataFrame:
    """(block, key, target, every): how often each block has each pair of
    tokens, and each task each token.  A key may come more than once."""
    width = _width(vocabulary)

    def rows(block: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            part = [x[i : i + 100_000] for x in (keys, *counts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), block, dtype=np.int64)), *map(pa.array, part)], names=["block", "key", "target", "every"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = np.zeros((2, vocabulary), dtype=np.int64)
        now, held, good, size = -1, [], [], 0
        for b in batches:
            for block, tokens, is_target in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(tokens.as_buffer(), dtype=width)
                np.add.at(single[1], ids, 1)
                if is_target:
                    np.add.at(single[0], ids, 1)
                keys, n = pairs_of(ids)
                if held and (block != now or size + len(keys) > BLOCK_TOKENS):
                    yield from rows(now, *_of_block(held, good))
                    held, good, size = [], [], 0
                now = block
                held.append((keys, n))
                good.append(is_target)
                size += len(keys)
        if size:
            yield from rows(now, *_of_block(held, good))
        used = np.flatnonzero(single[1])
        yield from rows(-1, used, single[:, used])

    return blocks.select("block", "tokens", "target").mapInArrow(count, "block bigint, key bigint, target bigint, every bigint")


class Models:
    """The token counts of both models, and the losses that they and the counts
    of pairs give.  Row 0 of each array is the target, row 1 the whole corpus."""

    def __init__(self, token: np.ndarray, target: np.ndarray, every: np.ndarray, vocabulary: int):
        self.vocabulary = vocabulary
        self.single = np.zeros((2, vocabulary), dtype=np.float64)
        self.single[0, token], self.single[1, token] = target, every
        self.total = self.single.sum(axis=1)
        #: What brings each model to the target's size; without a target they stay as they are.
        self.scale = np.array([1.0, self.total[0] / self.total[1] if self.total[0] else 1.0])

    def losses(self, ids: np.ndarray, own: tuple[np.ndarray, np.ndarray], is_target: bool, keys: np.ndarray, pairs: np.ndarray) -> tuple[float, float]:
        """The mean loss of a text's tokens in nats, in the target and in the
        background model, both without the text itself.  ``own`` are the pairs
        of the text; ``keys`` are sorted and hold all of them, ``pairs`` has
        their counts in either model."""
        if not len(ids):
            return 0.0, 0.0
        seen = np.array([[1.0 if is_target else 0.0], [1.0]])  # in which models the text is
        scale = self.scale[:, None]
        token, n_token = np.unique(ids, return_counts=True)
        single = np.maximum(self.single[:, token] - seen * n_token, 0.0) * scale
        total = np.maximum(self.total[:, None] - seen * len(ids), 0.0) * scale
        unigram = (single + 1.0) / (total + self.vocabulary)  # add-one smoothing over the shared vocabulary
        loss = -np.log(unigram[:, np.searchsorted(token, ids[0])])
        at, n = own
        pair = np.maximum(pairs[:, np.searchsorted(keys, at)] - seen * n, 0.0) * scale
        first, second = np.searchsorted(token, (at >> 32) - 1), np.searchsorted(token, at & 0xFFFFFFFF)
        loss -= (np.log((pair + PSEUDO * unigram[:, second]) / (single[:, first] + PSEUDO)) * n).sum(axis=1)
        return float(loss[0]) / len(ids), float(loss[1]) / len(ids)


def score_language(
    df: DataFrame,
    labels: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    vocabulary: int = 50_257,
    label_col: str = "quality",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, loss_target,
    loss_background, score (their difference; below 0: like the target).

    The target are all documents with a label of 1, the background is the whole
    corpus; each document is scored without its own counts.  A null or empty
    text has no tokens and scores 0; a null id is no target; repeated rows
    count as often as they stand there, and know each other.  Without a target
    the target model knows nothing but the vocabulary.
    """
    out = StructType.fromDDL("n_tokens bigint, loss_target double, loss_background double, score double")
    if id_col.lower() in out.fieldNames():
        raise ValueError(f"columns can't be named like those of the result: {[id_col]}")
    make = functools.partial(ByteBpe, json_path, ranks_path, pattern)
    width = _width(vocabulary)

    def encode(texts: list[bytes | None], bpe: ByteBpe) -> list[pa.Array]:
        return [pa.array([bpe.ids(t.decode("utf-8", "replace")).astype(width).tobytes() if t else b"" for t in texts], pa.binary())]

    encoded = map_texts(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", ["id"], "tokens binary", encode, make)
    good = labels.where(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias("__good")).where("__good is not null").distinct()
    both = encoded.join(small_side(good), encoded["id"] == F.col("__good"), "left").select("id", "tokens", F.col("__good").isNotNull().alias("target"))
    blocks = materialize(token_blocks(both, vocabulary), "tokens")
    own = materialize(block_counts(blocks, vocabulary), "bigrams")
    counts = materialize(own.groupBy("key").agg(F.sum("target").alias("target"), F.sum("every").alias("every")), "ngrams")
    rows = counts.where(F.col("key") < _PAIRS).toArrow()  # at most as many as the vocabulary has tokens
    models = Models(*(rows.column(c).to_numpy() for c in ("key", "target", "every")), vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(models)
    # What the other blocks have of each block's pairs.  Merged, whatever the sizes: a plan that turns at some size can't be foretold.
    mine = own.where(F.col("key") >= _PAIRS).select("block", "key", F.col("target").alias("my_target"), F.col("every").alias("my_every"))
    others = mine.join(counts.where(F.col("key") >= _PAIRS).hint("merge"), "key").where("every > my_every")
    others = others.select("block", "key", (F.col("target") - F.col("my_target")).alias("target"), (F.col("every") - F.col("my_every")).alias("every"))
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *out.fields])

    def score(docs: pa.Table, outside: pa.Table) -> pa.Table:
        texts = [np.frombuffer(t.as_buffer(), dtype=width) for t in docs.column("tokens")]
        is_target = docs.column("target").to_pylist()
        own = [pairs_of(ids) for ids in texts]
        keys, pairs = _of_block(own, is_target)
        if outside.num_rows:
            # A block may have several rows for a pair, each the whole without a part of the block: k of them are k wholes without the block's own.
            at = np.searchsorted(keys, outside.column("key").to_numpy())
            k = np.bincount(at, minlength=len(keys))
            for m, c in enumerate(("target", "every")):
                rest = np.bincount(at, weights=outside.column(c).to_numpy(), minlength=len(keys)).astype(np.int64)
                pairs[m] = np.where(k > 0, (rest + pairs[m]) // np.maximum(k, 1), pairs[m])
        losses = [shared.value.losses(ids, own, good, keys, pairs) for ids, own, good in zip(texts, own, is_target, strict=True)]
        target, background = np.array(losses, dtype=np.float64).T
        lengths = pa.array([len(ids) for ids in texts], pa.int64())
        return pa.Table.from_arrays([docs.column("id"), lengths, pa.array(target), pa.array(background), pa.array(target - background)], names=schema.fieldNames())

    return blocks.select("block", "id", "tokens", "target").groupBy("block").cogroup(others.groupBy("block")).applyInArrow(score, schema)
