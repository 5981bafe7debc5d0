"""Best-fit packing (operator 1): pattern packing by non-negative least squares.

Texts become token pieces of at most ``capacity`` tokens.  Only the histogram
of piece lengths (at most ``capacity`` numbers) reaches the driver, which

1. enumerates patterns of two to four lengths that fill a sequence exactly,
2. fits how often to repeat each pattern, by non-negative least squares
   against the histogram,
3. rounds the fit down to what the histogram holds, and
4. packs what remains by best fit on the histogram.

Each piece then finds its place by its rank among the pieces of its length.
Ranks come from windows over (length, salt), a length having so many salts
that no window holds more than about ``RANK_ROWS`` pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize

RANK_ROWS = 1_000
#: Patterns that the fit considers at most.
MOST_PATTERNS = 4000

_END = "<|endoftext|>"
#: Letters whose classes are the same in every Unicode version in use.
_UNUSUAL = re.compile("[^\x00-ɏ]")


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary.

    The ids are those of the ``tokenizers`` file.  Its rank file, the same
    vocabulary, is encoded by a faster library where both agree by
    construction: for texts of Latin letters that hold no special token's
    string.  All others go through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        self.json_path = json_path
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        """Only made where it is needed: it takes 100 MB."""
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.json_path)
        slow.no_truncation()
        slow.no_padding()
        return slow

    def ids(self, text: str) -> np.ndarray:
        if self.fast and _END not in text and (text.isascii() or not _UNUSUAL.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole if it fits, else pieces of
    ``capacity``, of which the first may be shorter."""
    n = len(ids)
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n > first else [(0, n)]


def token_pieces(df: DataFrame, make, capacity: int, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32."""
    piece = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def encode(texts: list[bytes | None], bpe: ByteBpe) -> list[pa.Array]:
        out = []
        for t in texts:
            ids = np.append(bpe.ids(t.decode("utf-8", "replace")) if t else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
            out.append([(i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(ids, capacity))])
        return [pa.array(out, pa.list_(piece))]

    got = map_texts(df, text_col, [id_col], "__pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>", encode, make)
    return got.select(F.col(f"`{id_col}`"), F.inline("__pieces"))


def exact_patterns(counts: np.ndarray, capacity: int, most: int = MOST_PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that are there and fill a sequence:
    every pair, then triples and quadruples that join the lengths which pairs
    leave over with frequent short ones."""
    there = [n for n in range(1, capacity) if counts[n]]
    out = [(n, capacity - n) for n in there if n >= capacity - n and counts[capacity - n]]
    short = sorted((n for n in there if n <= capacity // 2), key=lambda n: -counts[n])
    for a in sorted(there, key=lambda n: -n):
        got = 0
        for b in short:
            c = capacity - a - b
            if 0 < c <= b <= a and counts[c]:
                out.append((a, b, c))
                got += 1
                if got == 3 or len(out) >= most:
                    break
        if len(out) >= most:
            break
    frequent = short[:24]
    for i, a in enumerate(frequent):
        for b in frequent[i:]:
            for c in frequent[:8]:
                d = capacity - a - b - c
                if len(out) < most and 0 < d < capacity and counts[d] and d not in (a, b, c):
                    out.append(tuple(sorted((a, b, c, d), reverse=True)))
    return list(dict.fromkeys(out))


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeat counts x >= 0
    that bring the patterns' lengths near the histogram."""
    x = np.zeros(len(patterns))
    left = counts.astype(float).tolist()
    rows = []
    for p in patterns:
        uses: dict[int, int] = {}
        for n in p:
            uses[n] = uses.get(n, 0) + 1
        rows.append((list(uses.items()), sum(m * m for m in uses.values())))
    for _ in range(sweeps):
        moved = 0.0
        for j, (uses, norm) in enumerate(rows):
            step = max(-x[j], sum(m * left[n] for n, m in uses) / norm)
            if step:
                x[j] += step
                moved += abs(step)
                for n, m in uses:
                    left[n] -= m * step
        if moved < 0.5:
            break
    return x


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) whose lengths are exactly the histogram's."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        left[n] = k
    plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = exact_patterns(left, capacity)
    x = fit_repeats(patterns, left)
    for j in np.argsort(-x, kind="stable"):
        uses = {n: patterns[j].count(n) for n in patterns[j]}
        n = min([int(x[j] + 1e-9), *(int(left[k]) // m for k, m in uses.items())])
        if n > 0:
            plan.append((patterns[j], n))
            for k, m in uses.items():
                left[k] -= m * n
    # What remains: the longest piece opens a sequence, the longest that fits goes in next.
    there = [n for n in range(capacity, 0, -1) if left[n]]
    while there:
        pattern, room, uses = [], capacity, {}
        for n in there:
            m = min(room // n, int(left[n]))
            if m:
                pattern += [n] * m
                uses[n] = m
                room -= n * m
            if not room:
                break
        n = min(int(left[k]) // m for k, m in uses.items())
        plan.append((tuple(pattern), n))
        for k, m in uses.items():
            left[k] -= m * n
        there = [n for n in there if left[n]]
    return plan


class Places:
    """Where the piece with a given rank among those of its length goes."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], capacity: int):
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for pattern, n in plan:
            offset = 0
            for length in pattern:
                rows.setdefault(length, []).append((n, sequence, offset))
                offset += length
            sequence += n
        self.n_sequences = sequence
        for length, r in rows.items():
            a = np.array(r, dtype=np.int64)
            ends = np.cumsum(a[:, 0])
            self.by_length[length] = (ends, ends - a[:, 0], a[:, 1], a[:, 2])

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            ends, begins, first, place = self.by_length[int(n)]
            slot = np.searchsorted(ends, ranks[at], side="right")
            sequence[at] = first[slot] + ranks[at] - begins[slot]
            offset[at] = place[slot]
        return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a table of pieces (which is read more than
    once, so it should be a written one)."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_sequences(histogram, capacity)
    places = Places(plan, capacity)
    salts = F.element_at(F.array(*[F.lit(1 + histogram.get(n, 0) // RANK_ROWS) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(f"`{id_col}`", "piece"), salts).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))  # at most capacity + pieces / RANK_ROWS rows
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n")
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(f"`{id_col}`", "piece")) - 1)
    ranked = ranked.join(before, ["length", "__salt"]).select(*[f"`{c}`" for c in pieces.columns], (F.col("__rank") + F.col("__before")).alias("__rank"))
    k = len(pieces.columns)
    at = pieces.columns.index("length")
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema
    names = schema.fieldNames()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, o = places.of(b.column(at).to_numpy(), b.column(k).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(s), pa.array(o)], names=names)

    return ranked.mapInArrow(place, schema)


def pack_documents(
    df: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = 1024,
    end_id: int = 2,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Pack the token ids of every text, each followed by ``end_id``, into
    sequences of at most ``capacity`` tokens.

    One row per piece: ``id_col``, piece, start, length, ids_crc32,
    sequence_id, offset.  A null text is empty: one piece that holds only
    ``end_id``.  Rows of a repeated or null id are documents of their own.
    Other columns are not read.  An empty table gives an empty result.
    """
    make = functools.partial(ByteBpe, json_path, ranks_path, pattern)
    pieces = materialize(token_pieces(df, make, capacity, end_id, text_col, id_col), "pieces")
    return pack_pieces(pieces, capacity, id_col)
