"""Helpers shared by the corpus operators: byte-bounded Arrow batches, word
hashing over raw UTF-8 buffers and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one call of a batch function gets, unless one text alone is longer.
BATCH_BYTES = 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session, or else the folder that the
    context was given.  Only on a single machine, as in tests, a temporary
    folder is made once where neither is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif context.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="sylvan-")
            context.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/sylvan-{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as that knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: this cuts
    the lineage, and survives the loss of executors.  The table goes when the
    application ends, or with :func:`discard`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    store, at = _store(spark, path)
    store.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylvan_scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` has made, once nothing reads them."""
    for t in tables:
        store, at = _store(t.sparkSession, t._sylvan_scratch)
        store.delete(at, True)


#: Rows of keys that are broadcast at most: some 100 MB in memory.
SMALL_ROWS = 250_000
#: The same for the tables of a graph's nodes, of which several are there at once.
SMALL_NODES = 100_000


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """One side of a join: counted, then broadcast if it has at most ``most``
    rows (SMALL_ROWS), and merged if it has more."""
    return F.broadcast(df) if df.count() <= (SMALL_ROWS if most is None else most) else df.hint("merge")


def small_nodes(df: DataFrame) -> DataFrame:
    """:func:`small_side` for at most SMALL_NODES rows.  Spark itself goes by
    the bytes of a table's files, of which numbers take few, and by a fixed size
    for arrays, and would send tables through the driver that are many times
    as large in memory."""
    return small_side(df, SMALL_NODES)


def merged_nodes(df: DataFrame) -> DataFrame:
    """A side of a join that isn't to be broadcast, though Spark may size it
    low: merged if it has more than SMALL_NODES rows."""
    return df if df.count() <= SMALL_NODES else df.hint("merge")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the letters' case."""
    used = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in used:
        name = "_" + name
    return name


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, length) row ranges with at most ``most`` bytes each;
    a longer text gets a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield i, j - i
        i = j


def map_texts(
    df: DataFrame,
    text_col: str,
    carry: list[str],
    out: str,
    fn: Callable[[list[bytes | None]], list[pa.Array]],
    make: Callable[[], object] | None = None,
) -> DataFrame:
    """Apply ``fn`` to byte-bounded batches of a text column.

    ``carry`` names the columns that are handed through unchanged, ``out`` is
    the DDL of the columns that ``fn`` returns as Arrow arrays in that order.
    ``fn`` gets a list of UTF-8 texts (None for null), and what ``make``
    returned once per task, if given.
    """
    inner = StructType.fromDDL(out)
    if clash := {c.lower() for c in carry} & {f.name.lower() for f in inner.fields}:
        raise ValueError(f"columns can't be named like those of the result: {sorted(clash)}")
    picked = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = StructType([*(f for f in picked.schema.fields if f.name != "__text"), *inner.fields])
    names = [f.name for f in schema.fields]
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = [make()] if make else []
        for batch in batches:
            texts = batch.column(k)
            for start, n in byte_slices(texts):
                got = fn(texts.slice(start, n).to_pylist(), *extra)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, n) for i in range(k)), *got], names=names)

    return picked.mapInArrow(run, schema)


# --- words and shingles as 64-bit hashes, over raw bytes -------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], cache: dict[bytes, int] | None = None) -> np.ndarray:
    """A 64-bit hash for each word; each distinct word is hashed once."""
    import xxhash

    if not words:
        return np.zeros(0, dtype=np.uint64)
    coded = pa.array(words, type=pa.binary()).dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return each[np.asarray(coded.indices)]


def shingle_hashes(texts: list[bytes | None], k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all ``k``-word shingles of each text, and each text's count.

    Words are runs of anything but ASCII white space, A-Z in lower case.  A
    text of fewer than ``k`` words has its whole word sequence as one shingle;
    one without words, or null, has none.  Repeated shingles are kept.
    """
    words: list[bytes] = []
    n_words = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            own = (t.lower() if lower else t).split()
            n_words[i] = len(own)
            words += own
    h = word_hashes(words)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64), counts
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    out = np.zeros(total, dtype=np.uint64)
    short = np.repeat(np.where(n_words < k, n_words, k), counts)
    padded = np.concatenate([h, np.zeros(k, dtype=np.uint64)])
    for j in range(k):
        step = mix(out * _ODD + padded[at + j] + np.uint64(j + 1))
        out = np.where(short > j, step, out) if (n_words < k).any() else step
    return out, counts


def distinct_by_group(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each consecutive group, and their counts."""
    group = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return v[keep], np.bincount(g[keep], minlength=len(counts)).astype(np.int64)


def sql_string(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))
