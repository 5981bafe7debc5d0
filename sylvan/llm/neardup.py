"""MinHash near-duplicate detection (operator 7) with tensored banding.

A document has ``HALVES`` half keys of ``ROWS`` minhashes each; every pair of
half keys forms the key of one table.  12 half keys of two minhashes give 66
tables of four minhashes from 24 computed ones, where separate tables would
need 264.  Documents with a Jaccard similarity of 0.8 share a table unless
fewer than two half keys agree, which happens once in about 9,000 pairs at
exactly 0.8, and once in 160,000 at 0.85.

Candidates are verified on the full sets of 64-bit shingle hashes.  Before
that, an exact bound on the intersection is taken from bitmaps: a bit that only
one of two documents has stands for at least one shingle that only it has.  No
bucket is handed on as all its pairs.  Documents with equal sets collapse
first; in each bucket the most central document is compared with the others.
Only buckets whose documents are still in different components go on.  Where at
most ``SMALL_BUCKET`` documents are outside of a bucket's main component, these
are compared with all of the bucket, once for all tables that two documents
share.  The documents of other buckets are joined on the rarest of their
shingles instead: of two sets that are similar enough, each has one of the
other's ``n - need + 1`` rarest, whatever they hold of a text that thousands
share, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, distinct_by_group, fresh, map_texts, materialize, merged_nodes, mix, shingle_hashes, small_nodes
from .components import connected_components

HALVES, ROWS = 12, 2
#: Bits of the bitmaps, in numbers of 64.
BITMAP = 32
#: Documents outside of a bucket's main part that are compared with all of it, at most.
SMALL_BUCKET = 64
#: Frequent shingles that tasks know of: 16 bytes each.
FREQUENT = 200_000
#: One in so many documents tells which shingles are frequent.
ORDER_ONE_IN = 4
_PAIRS = [(i, j) for i in range(HALVES) for j in range(i + 1, HALVES)]


def minhashes(values: np.ndarray, counts: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """The ``n`` minhashes of each group of hashes; groups without any get 0."""
    out = np.zeros((len(counts), n), dtype=np.uint64)
    full = counts > 0
    if not full.any():
        return out
    starts = (np.cumsum(counts) - counts)[full]
    k = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    for j in range(n):
        out[full, j] = np.minimum.reduceat(values * (k[2 * j] | np.uint64(1)) ^ k[2 * j + 1], starts)
    return out


def _digests(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A 128-bit digest of each group of sorted distinct hashes."""
    import xxhash

    ends = np.cumsum(counts)
    return pa.array([xxhash.xxh3_128_digest(values[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True)], pa.binary())


def signatures(df: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """One row per document: id, n (distinct shingles), digest (of their set),
    halves (32 bits of each half key)."""

    def sign(texts: list[bytes | None]) -> list[pa.Array]:
        values, counts = distinct_by_group(*shingle_hashes(texts, width))
        m = minhashes(values, counts, HALVES * ROWS)
        half = np.zeros((len(texts), HALVES), dtype=np.uint64)
        for r in range(ROWS):
            half = mix(half + m[:, r::ROWS] + np.uint64(r + 1))
        halves = (half >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return [pa.array(counts, pa.int64()), _digests(values, counts), pa.array(list(halves), pa.list_(pa.int32()))]

    taken = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(taken, "text", ["id"], "n bigint, digest binary, halves array<int>", sign)


def shingle_sets(df: DataFrame, width: int, text_col: str, carry: list[str]) -> DataFrame:
    """``carry``, then (n, set_digest, shingles, bitmap): the distinct shingle
    hashes of each document, and the bits that they set."""

    def collect(texts: list[bytes | None]) -> list[pa.Array]:
        values, counts = distinct_by_group(*shingle_hashes(texts, width))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        bits = np.zeros((len(texts), 64 * BITMAP), dtype=bool)
        bits[np.repeat(np.arange(len(texts)), counts), (values % np.uint64(64 * BITMAP)).astype(np.int64)] = True
        bitmap = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
        return [pa.array(counts, pa.int64()), _digests(values, counts), sets, pa.array(list(bitmap), pa.list_(pa.int64()))]

    return map_texts(df, text_col, carry, "n bigint, set_digest binary, shingles array<bigint>, bitmap array<bigint>", collect)


def table_keys() -> Column:
    """The tables' keys, one for each pair of half keys, with the table's number."""
    return F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("halves")[i], F.col("halves")[j]).alias("key"), F.lit(k).alias("table")) for k, (i, j) in enumerate(_PAIRS)])


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, terms)


def _in_bound(percent: int) -> Column:
    """Whether sizes and bitmaps of a and b allow a link; both bounds are exact."""
    only = lambda x, y: _sum([F.bit_count(F.col(f"bitmap_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bitmap_{y}")[i]))) for i in range(BITMAP)])
    common = F.least(F.col("n_a") - only("a", "b"), F.col("n_b") - only("b", "a"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & ((100 + percent) * common >= percent * (F.col("n_a") + F.col("n_b")))


def _first_meeting() -> Column:
    """Whether this is the first of the tables that a and b share: no half key
    before the table's second one agrees, but its first one."""
    before = F.array(*[F.lit(((1 << j) - 1) & ~(1 << i)) for i, j in _PAIRS])
    agree = _sum([F.when(F.col("halves_a")[k] == F.col("halves_b")[k], 1 << k).otherwise(0) for k in range(HALVES)])
    return agree.bitwiseAND(F.element_at(before, F.col("table_a") + 1)) == 0


def _side(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """The columns with ``x`` behind their names, but for the keys."""
    return df.select(*[F.col(c).alias(c if c in (keys or ("key",)) else f"{c}_{x}") for c in df.columns])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (node_a, node_b) whose full sets are similar enough."""
    both = pairs.join(_side(sets, "b"), "node_b").join(_side(sets, "a"), "node_a")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("node_a", "node_b")


def _meetings(loose: DataFrame, bounds: DataFrame, halves: DataFrame, percent: int) -> DataFrame:
    """(node_a, node_b) of buckets (key, table, node, part, main) that have few
    documents outside of their main part: these with all others of the bucket,
    within the bounds, once for all tables that two documents share."""
    full = loose.join(bounds, "node").join(small_nodes(halves), "node")
    once = (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main_a")) | (F.col("node_a") < F.col("node_b")))
    pairs = _side(full.where("part <> main"), "a", "key").join(_side(full.drop("main"), "b", "key"), "key").where(once & _first_meeting() & _in_bound(percent))
    return pairs.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b")).distinct()


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are frequent among ``docs``, and how frequent: at
    most FREQUENT of them, counted over one document in ORDER_ONE_IN.  They only
    order the shingles, and any order finds the same links; a good one finds them soon."""
    some = docs.where(F.pmod(F.xxhash64("node"), F.lit(ORDER_ONE_IN)) == 0).select(F.explode("shingles").alias("s"))
    got = some.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    s, n = got.column("s").to_numpy(), got.column("count").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def rare_meetings(docs: DataFrame, percent: int) -> DataFrame:
    """(node_a, node_b): a superset of the similar pairs of different parts
    among ``docs`` (node, part, n, shingles, bitmap), found by exact filters.

    With each set's shingles in one order, from rare to frequent, the first
    that two similar sets share comes early in both: so early that what is
    behind it still suffices (``need`` of either's shingles at least, and by
    both sizes for the pair itself).  The smaller set of a pair is looked up by
    fewer shingles than the larger one, as more than ``need`` of it must be
    shared.  A shingle's most frequent part isn't joined with itself, and sizes
    within the bound fall into the same or neighbouring bands.  The bitmaps'
    bound is part of the join, so that pairs that it rules out are never rows.
    """
    frequent, counts = frequent_shingles(docs)
    # A step of the bands is the largest ratio of sizes that the bound allows.
    step = float(np.log(100 / percent) + 1e-9) if percent < 100 else 1e-9
    schema = "s bigint, node bigint, part bigint, n bigint, rank bigint, few boolean, band bigint"

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for node, part, n, shingles in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                s = shingles.values.to_numpy()
                weight = np.zeros(len(s), dtype=np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    weight = np.where(frequent[at] == s, counts[at], 0)
                larger = n - -(-percent * n // 100) + 1
                smaller = n - -(-2 * percent * n // (100 + percent)) + 1
                first = s[np.lexsort((s, weight))[:larger]]
                rank = np.arange(1, len(first) + 1)
                for column, values in zip(out, (first, *(np.full(len(first), x) for x in (node, part, n)), rank, rank <= smaller, np.full(len(first), int(np.log(n) / step))), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["s", "node", "part", "n", "rank", "few", "band"])

    rare = materialize(docs.select("node", "part", "n", "shingles").mapInArrow(early, schema), "rare")
    main = rare.groupBy("s", "part").count().groupBy("s").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    told = merged_nodes(rare).join(main, "s").withColumn("minor", F.col("part") != F.col("main")).join(docs.select("node", "bitmap"), "node")
    larger = _side(told.withColumn("at", F.explode(F.expr("array(band - 1, band)"))).drop("band", "few", "main"), "a", "s", "at")
    smaller = _side(told.where("few").withColumnRenamed("band", "at").drop("few", "main"), "b", "s", "at")
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    order = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    soon = 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) >= need
    meet = (F.col("part_a") != F.col("part_b")) & order & soon & _in_bound(percent)
    pairs = [
        larger.where(a).join(smaller.where(b), ["s", "at"]).where(meet).select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"))
        for a, b in (("minor_a", "true"), ("not minor_a", "minor_b"))
    ]
    out = materialize(pairs[0].unionByName(pairs[1]).distinct(), "meetings")
    discard(rare)
    return out


def place_documents(df: DataFrame, width: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """A written table with a row for each input row: id, digest, n, root (the
    smallest id reachable; null for a null id)."""
    signed = materialize(signatures(df, width, text_col, id_col), "signatures")
    usable = signed.where("n > 0 and id is not null")
    # Equal sets are one node, which is numbered when the table is written.
    classes = usable.groupBy("digest").agg(F.min("id").alias("id"), F.first("halves").alias("halves"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("node", F.inline(table_keys()))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(keyed.hint("merge").join(sizes, "key"), "shared")  # (key, node, table, size): buckets of two and more

    # The texts of the nodes in them: of each node its smallest id's, told by their digest from others of that id.
    chosen = classes.join(shared.select("node").distinct(), "node", "left_semi").select("id", "node", "digest")
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(small_nodes(chosen), "id").select("node", "digest", "text")
    sets = shingle_sets(texts, width, "text", ["node", "digest"]).where("digest = set_digest").select("node", "n", "shingles", "bitmap")
    sets = materialize(sets, "sets")
    if sets.count() > sets.select("node").distinct().count():  # rows that repeat
        repeated, sets = sets, materialize(sets.dropDuplicates(["node"]), "sets")
        discard(repeated)
    bounds = sets.select("node", "n", "bitmap")

    wide = merged_nodes(shared)
    # In each bucket, the document with the most company is compared with all others.
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    centre = wide.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("node_a"))
    stars = wide.join(centre, "key").where("node <> node_a").select("node_a", F.col("node").alias("node_b")).distinct()
    stars = stars.join(_side(bounds, "b"), "node_b").join(_side(bounds, "a"), "node_a").where(_in_bound(percent)).select("node_a", "node_b")
    links = materialize(_verified(stars, sets, percent), "links")

    # Documents of a bucket that are in different components now are compared with each other.
    part = connected_components(links, "node_a", "node_b")
    placed = shared.join(small_nodes(part), "node", "left").select("key", "table", "node", F.coalesce("component", "node").alias("part"))
    parts = placed.groupBy("key", "part").count().groupBy("key")
    open_keys = parts.agg(F.max_by("part", F.struct("count", "part")).alias("main"), (F.sum("count") - F.max("count")).alias("minor")).where("minor > 0")
    loose = materialize(placed.join(open_keys, "key"), "loose")
    few = _meetings(loose.where(F.col("minor") <= SMALL_BUCKET).drop("minor"), bounds, classes.select("node", "halves"), percent)
    many = loose.where(F.col("minor") > SMALL_BUCKET).select("node", "part").distinct().join(sets, "node")
    meetings = rare_meetings(many, percent)
    all_links = materialize(links.unionByName(_verified(few.unionByName(meetings).distinct(), sets, percent)), "links")
    discard(shared, sets, part, loose, meetings, links)

    whole = connected_components(all_links, "node_a", "node_b")
    grouped = classes.join(small_nodes(whole), "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("id").alias("root"))
    roots = grouped.join(least, "component").select("digest", "root")
    alone = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("root")).otherwise(F.col("id"))
    out = materialize(signed.drop("halves").join(roots, "digest", "left").select("id", "digest", "n", alone.alias("root")), "placed")
    discard(signed, classes, all_links, whole)
    return out


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    Two documents are linked if 100 times the size of the intersection of
    their sets of ``width``-word shingles is at least ``percent`` times that of
    the union.  ``component_id`` is the smallest id reachable, ``kept`` whether
    that is the row's own.  Empty and null texts are linked with nothing.
    Repeated rows get equal results, and rows that share an id but not a text
    are each placed by their own text.  A null id is linked with nothing:
    component_id is null, and the row is kept.  Ids may be of any type that
    has an order.
    """
    return place_documents(df, width, percent, text_col, id_col).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("root").alias("component_id"),
        F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates, with its columns: that of the
    smallest id.

    Of rows that repeat an id and its set of shingles one stays; rows of one id
    with different texts are each placed by their own text.  Empty and null texts and null ids are in no group: all
    such rows stay but for repeated ones that have an id.
    """
    placed = place_documents(df, width, percent, text_col, id_col)
    ids = placed.where("id is not null").groupBy("id").agg(F.count("*").alias("rows"), F.max("root").alias("root"))
    dropped = ids.where("rows = 1 and root <> id").select("id")
    repeated = ids.where("rows > 1").select("id")
    own = F.col(f"`{id_col}`")
    columns = [f"`{c}`" for c in df.columns]
    single = df.join(small_nodes(dropped.unionByName(repeated)).withColumnRenamed("id", "__id"), own == F.col("__id"), "left_anti")
    again = df.join(small_nodes(repeated).withColumnRenamed("id", "__id"), own == F.col("__id"), "left_semi")
    digest = fresh(df, "set_digest")
    make = lambda texts: [_digests(*distinct_by_group(*shingle_hashes(texts, width)))]
    told = map_texts(again, text_col, df.columns, f"`{digest}` binary", make)
    kept = placed.where("root = id").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    told = told.join(kept, (own == F.col("__id")) & (F.col(f"`{digest}`") == F.col("__digest")), "left_semi")
    return single.select(*columns).unionByName(told.dropDuplicates([id_col, digest]).select(*columns))
