"""Benchmark decontamination (operator 9): size-partitioned MinHash containment
search, verified by exact shingle containment.

Items are partitioned by their number of shingles, at powers of two.  For each
partition a document is seen through windows of two blocks that overlap by one
block, a block being as long as the partition's longest item: a passage lies
wholly within one window, however long the document is, and makes up at least
a quarter of it, unless it repeats itself or lies scattered.  Minhashes alone
would miss such items, so candidates are also found exactly: an item of which a
document has at least ``need`` of ``n`` distinct shingles has one of any
``n - need + 1`` of them in it, and the rarest so many of each item are looked
up among the document's shingles.  The documents that either way finds are
candidates, for which all of the item's shingles are looked up.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import discard, fresh, map_texts, materialize, mix, shingle_hashes

HASHES = 48
WIDTH = 5
#: Items that one pass over the documents takes; about 1 kB of index each.
ITEMS_PER_PASS = 50_000
#: Bytes of their texts that one pass takes; 8 bytes of index for each word.
BYTES_PER_PASS = 64 << 20
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain(text: bytes | None) -> bytes | None:
    """Lower case, with ASCII punctuation as white space."""
    if not text:
        return text
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return low.translate(_PLAIN)


def _factors() -> np.ndarray:
    return mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) + np.uint64(0x51ED2701))


class ItemIndex:
    """The minhashes of all items of a pass, by size class, and their rarest shingles."""

    def __init__(self, texts: list[bytes | None], width: int = WIDTH, percent: int = 80):
        values, counts = shingle_hashes([plain(t) for t in texts], width)
        ends = np.cumsum(counts)
        self.sets = [np.unique(values[e - c : e]) for e, c in zip(ends, counts, strict=True)]
        self.width = width
        k = _factors()
        by_class: dict[int, list[int]] = {}
        for i, c in enumerate(counts):
            if c:
                by_class.setdefault(int(c - 1).bit_length(), []).append(i)
        #: block length -> for each hash function: bitmap, sorted minhashes, their items
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for c, items in sorted(by_class.items()):
            bits = min(18, max(10, (16 * len(items)).bit_length()))  # about one window in 16 or more goes on to the exact lookup
            tables = []
            for j in range(HASHES):
                low = np.array([(self.sets[i] * (k[2 * j] | np.uint64(1)) ^ k[2 * j + 1]).min() for i in items], dtype=np.uint64)
                order = np.argsort(low, kind="stable")
                bitmap = np.zeros(1 << bits, dtype=bool)
                bitmap[(low >> np.uint64(64 - bits)).astype(np.int64)] = True
                tables.append((bitmap, low[order], np.array(items)[order]))
            self.classes[1 << c] = tables
        self._index_rarest(percent)

    def _index_rarest(self, percent: int) -> None:
        """Sorted shingles, their items and a bitmap: of each item as many as
        a document that contains it can't lack all of."""
        sizes = np.array([len(x) for x in self.sets], dtype=np.int64)
        values = np.concatenate([*self.sets, np.zeros(0, dtype=np.uint64)])
        _, which, often = np.unique(values, return_inverse=True, return_counts=True)
        item = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((values, often[which], item))  # within an item the rarest first
        rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        need = np.maximum(1, -(-percent * sizes // 100))
        order = order[rank < np.repeat(sizes - need + 1, sizes)]
        order = order[np.argsort(values[order], kind="stable")]
        self.rare, self.rare_items = values[order], item[order]
        bits = min(22, max(10, (16 * len(order)).bit_length()))
        self.rare_bits = np.zeros(1 << bits, dtype=bool)
        self.rare_bits[(self.rare >> np.uint64(64 - bits)).astype(np.int64)] = True

    def exact_candidates(self, values: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of which the document has one of the item's rarest shingles."""
        shift = np.uint64(64 - (len(self.rare_bits).bit_length() - 1))
        hit = np.flatnonzero(self.rare_bits[(values >> shift).astype(np.int64)])
        first, last = (np.searchsorted(self.rare, values[hit], side=side) for side in ("left", "right"))
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = np.repeat(np.repeat(np.arange(len(counts)), counts)[hit], n)
        pairs = np.unique(doc * len(self.sets) + self.rare_items[at])
        return {divmod(int(x), len(self.sets)) for x in pairs}

    def candidates(self, values: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share a minhash in a window."""
        found: set[tuple[int, int]] = set()
        if not len(values) or not self.classes:
            return found
        k = _factors()
        full = np.flatnonzero(counts)
        sizes = [counts[full]]
        lengths = sorted(self.classes)
        levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # block length, starts within the level below, document of each block
        before = 1
        for b in lengths:
            below = sizes[-1]
            step = b // before
            n = -(-below // step)
            first = np.cumsum(below) - below
            own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            levels.append((b, np.repeat(first, n) + own * step, np.repeat(full, n)))
            sizes.append(n)
            before = b
        for j in range(HASHES):
            low = values * (k[2 * j] | np.uint64(1)) ^ k[2 * j + 1]
            for b, starts, doc in levels:
                low = np.minimum.reduceat(low, starts)
                joined = np.where(doc[1:] == doc[:-1], np.minimum(low[1:], low[:-1]), low[:-1])
                window = np.append(joined, low[-1])
                bitmap, keys, items = self.classes[b][j]
                shift = np.uint64(64 - (len(bitmap).bit_length() - 1))
                hit = np.flatnonzero(bitmap[(window >> shift).astype(np.int64)])
                for w in hit[np.isin(window[hit], keys)]:
                    i = int(np.searchsorted(keys, window[w]))
                    while i < len(keys) and keys[i] == window[w]:
                        found.add((int(doc[w]), int(items[i])))
                        i += 1
        return found

    def search(self, texts: list[bytes | None], percent: int) -> list[list[tuple[int, int]]]:
        """For each text the (item, shared shingles) of which it contains at
        least ``percent`` per cent."""
        values, counts = shingle_hashes([plain(t) for t in texts], self.width)
        ends = np.cumsum(counts)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        sets: dict[int, np.ndarray] = {}
        for d, i in sorted(self.candidates(values, counts) | self.exact_candidates(values, counts)):
            if d not in sets:
                sets[d] = np.unique(values[ends[d] - counts[d] : ends[d]])
            shared = int(np.isin(self.sets[i], sets[d], assume_unique=True).sum())
            if 100 * shared >= percent * len(self.sets[i]):
                out[d].append((i, shared))
        return out


def _with_hits(df: DataFrame, items: list[tuple], kind: DataType, percent: int, width: int, text_col: str, carry: list[str], out: str) -> DataFrame:
    # The index is made here once and travels with the tasks: at most ITEMS_PER_PASS items and BYTES_PER_PASS of text.
    index = ItemIndex([t for _, t in items], width, percent)
    ids = [i for i, _ in items]
    arrow = pa.list_(pa.struct([("item", to_arrow_type(kind)), ("shared", pa.int64()), ("shingles", pa.int64())]))

    def find(texts: list[bytes | None]) -> list[pa.Array]:
        return [pa.array([[(ids[i], n, len(index.sets[i])) for i, n in hits] for hits in index.search(texts, percent)], arrow)]

    return map_texts(df, text_col, carry, f"`{out}` array<struct<item:{kind.simpleString()},shared:bigint,shingles:bigint>>", find)


def _passes(items: DataFrame, text_col: str, id_col: str) -> tuple[int, Iterator[list[tuple]]]:
    """How many passes there are, and each one's items, collected one pass at a
    time: about ITEMS_PER_PASS of them or BYTES_PER_PASS of text, by hash."""
    items = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    every = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).first()
    n = 1 + max(every.n // ITEMS_PER_PASS, (every.bytes or 0) // BYTES_PER_PASS)
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(n))
    return n, ([(r.id, bytes(r.text) if r.text is not None else None) for r in items.where(part == i).collect()] for i in range(n))


def contaminated(df: DataFrame, items: DataFrame, percent: int = 80, width: int = WIDTH, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(``id_col``, item_id, n_shared, n_item, containment): every document and
    item of which the document contains at least ``percent`` per cent of the
    distinct ``width``-word shingles.

    A text of fewer words has its whole word sequence as one shingle; texts
    without words, and null texts, have none and match nothing.  Repeated
    documents or items give repeated rows; null ids are handed on.  Ids may be
    of any type.
    """
    kind = items.schema[item_id].dataType
    n, passes = _passes(items, item_text, item_id)
    got = []
    for part in passes:
        hits = _with_hits(df, part, kind, percent, width, text_col, [id_col], "__hits").select(F.col(f"`{id_col}`"), F.explode("__hits").alias("h"))
        got.append(hits if n == 1 else materialize(hits, "hits"))  # written, so that one index at a time is held
    return reduce(DataFrame.unionByName, got).select(
        F.col(f"`{id_col}`"),
        F.col("h.item").alias("item_id"),
        F.col("h.shared").alias("n_shared"),
        F.col("h.shingles").alias("n_item"),
        (F.col("h.shared") / F.col("h.shingles")).alias("containment"),
    )


def without_contaminated(df: DataFrame, items: DataFrame, percent: int = 80, width: int = WIDTH, text_col: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``df`` that contain no item, with their columns.  Null and
    empty texts contain none; of repeated rows all stay, or all go."""
    columns = df.columns
    hits = fresh(df, "hits")
    kind = items.schema[item_id].dataType
    n, passes = _passes(items, item_text, item_id)
    for i, part in enumerate(passes):
        before = df
        df = _with_hits(df, part, kind, percent, width, text_col, columns, hits).where(F.size(f"`{hits}`") == 0).select(*[f"`{c}`" for c in columns])
        if n > 1:  # written, so that one index at a time is held
            df = materialize(df, "clean")
            if i:
                discard(before)
    return df
