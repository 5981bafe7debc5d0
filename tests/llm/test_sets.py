"""Near duplicates, components, decontamination and shingles."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylvan.llm import common, decontam, neardup
from sylvan.llm import components as components_of
from sylvan.llm.common import distinct_by_group, shingle_hashes
from sylvan.llm.components import connected_components


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(ids, links):
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(ids, links), {i: len(s) for i, s in sets.items()}


@settings(max_examples=50)
@given(st.lists(st.none() | st.text(alphabet="aA b\té\n", max_size=25), max_size=6), st.integers(1, 5))
def test_shingle_hashes(texts, k):
    values, counts = distinct_by_group(*shingle_hashes([None if t is None else t.encode() for t in texts], k))
    assert list(counts) == [len(shingles(t, k)) for t in texts]
    ends = np.cumsum(counts)
    mine = [frozenset(values[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True)]
    for a, x in zip(texts, mine, strict=True):
        for b, y in zip(texts, mine, strict=True):
            assert len(x & y) == len(shingles(a, k) & shingles(b, k))


@pytest.mark.parametrize("k", [2, 5])
def test_edges_equal_brute_force(edges, edge_rows, no_rows, k):
    want, sizes = brute([(r[0], r[1]) for r in edge_rows], k)
    got = neardup.near_duplicates(edges, width=k).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(no_rows).count() == 0


@pytest.mark.parametrize("small_bucket", [neardup.SMALL_BUCKET, 1])
def test_chains_and_hubs_equal_brute_force(spark, monkeypatch, small_bucket):
    """Near copies of an original, of which many are too far from each other,
    chains of small changes, and texts that share a passage only."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small_bucket)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(30)]
    original = [word() for _ in range(120)]
    for _ in range(60):
        w = list(original)
        for at in rng.sample(range(120), rng.randint(1, 9)):
            w[at] = word()
        rows.append(w)
    chain = [word() for _ in range(80)]
    for _ in range(25):
        chain = list(chain)
        chain[rng.randrange(80)] = word()
        chain[rng.randrange(80)] = word()
        rows.append(chain)
    rows += [passage + [word() for _ in range(rng.randint(5, 40))] for _ in range(40)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want, _ = brute(rows, 2)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()}
    assert got == want


def test_rows_that_share_an_id_are_placed_by_their_own_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (5, a + " x"), (5, b), (9, b + " y"), (5, b), (7, None), (7, ""), (7, ""), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df, width=2).collect())
    assert got == sorted([(1, 39, 1, True), (5, 40, 1, False), (5, 39, 5, True), (5, 39, 5, True), (9, 40, 5, False)] + [(7, 0, 7, True)] * 3 + [(-1, 39, -1, True)] * 2)
    kept = sorted((r.doc_id or -1, r.text or "") for r in neardup.without_near_duplicates(df, width=2).collect())
    assert kept == sorted([(1, a), (5, b), (7, ""), (-1, a), (-1, a)])


def test_ids_of_any_type_and_extra_columns(spark, edges, no_rows):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([("b", text, {"x": 1}), ("a", text, {}), ("c", "else", None)], "key string, body string, more map<string,int>")
    got = {r.key: (r.component_id, r.kept) for r in neardup.near_duplicates(df, text_col="body", id_col="key").collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True)}
    kept = neardup.without_near_duplicates(df, text_col="body", id_col="key")
    assert kept.columns == df.columns and sorted(r.key for r in kept.collect()) == ["a", "c"]
    assert neardup.without_near_duplicates(edges).columns == edges.columns and neardup.without_near_duplicates(no_rows).count() == 0


def test_many_pages_of_one_template(spark):
    """One bucket of pages that share two thirds of their shingles, and no more: no pair of them is a candidate."""
    from pyspark.sql import functions as F

    template = " ".join(f"t{i}" for i in range(100))
    pages = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(template), *[F.concat(F.lit("own"), F.col("id"), F.lit("x"), F.lit(i)) for i in range(45)]).alias("text"))
    sets = neardup.shingle_sets(pages.select(F.col("doc_id").alias("node"), "text"), 2, "text", ["node"]).withColumn("part", F.col("node"))
    assert neardup.rare_meetings(sets, 80).count() == 0
    near = spark.range(2000, 2010).select(F.col("id").alias("doc_id"), F.concat(F.lit(template), F.lit(" own"), F.col("id")).alias("text"))
    got = neardup.near_duplicates(pages.unionByName(near), width=2).where("doc_id <> component_id").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, 2000) for i in range(2001, 2010)]


def test_pairs_out_of_the_bitmaps_bound_are_no_rows(spark, monkeypatch):
    """Documents that share half of their shingles and meet on them, as no order tells which are frequent."""
    monkeypatch.setattr(neardup, "FREQUENT", 0)
    rows = [(i, " ".join([f"t{j}" for j in range(70)] + [f"own{i}x{j}" for j in range(30)])) for i in range(40)]
    rows += [(i, " ".join([f"n{j}" for j in range(100)] + [f"own{i}"])) for i in (40, 41)]
    sets = neardup.shingle_sets(spark.createDataFrame(rows, "node bigint, text string"), 1, "text", ["node"])
    got = neardup.rare_meetings(sets.select("node", F.col("node").alias("part"), "n", "shingles", "bitmap"), 80)
    assert [tuple(r) for r in got.collect()] == [(40, 41)]


def test_the_bitmap_bound_loses_nothing(spark):
    rng = random.Random(2)
    rows = []
    for i in range(30):
        w = [str(x) for x in range(rng.randint(1, 5000))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + ["z"] * 1 + [str(rng.random()) for _ in range(len(w) // 8)]))]
    sets = neardup.shingle_sets(spark.createDataFrame(rows, "node bigint, text string"), 1, "text", ["node"])
    from pyspark.sql import functions as F

    both = neardup._side(sets, "a").crossJoin(neardup._side(sets, "b"))  # 3600 rows
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    linked = 100 * common >= 80 * (F.col("n_a") + F.col("n_b") - common)
    assert both.where(linked & ~neardup._in_bound(80)).count() == 0 and both.where(linked).count() > 60


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(3, 3), (5, 4), (4, 5), (9, 8), (8, 7)]])
def test_components(spark, links):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == components(sorted({x for p in links for x in p}), links)


# --- decontamination ---


def norm(text):
    return (decontam.plain((text or "").encode()) or b"").decode()


def brute_hits(docs, items, percent=80):
    out = set()
    for d, t in docs:
        own = shingles(norm(t), 5)
        for i, s in items:
            want = shingles(norm(s), 5)
            n = len(own & want)
            if want and 100 * n >= percent * len(want):
                out.add((d, i, n, len(want)))
    return out


def test_passages_are_found(spark, edges, edge_rows, no_rows):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 9, 12, 20, 36, 59, 90, 200, 33] * 3)] + [(100, None), (101, "  "), (102, "one two"), (None, "a null id with some words"), (0, "again under an old id, that is")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 3000))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(items[:30])[1].split()
            if rng.random() < 0.4 and len(passage) > 20:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [p.upper() + rng.choice(["", ",", "!"]) for p in passage]
        docs.append((i, " ".join(w)))
    docs += [(500, "One\ttwo"), (501, None), (502, "one two three")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contaminated(df, bench).collect()}
    assert got == brute_hits(docs, items) and (500, 102, 1, 1) in got
    clean = decontam.without_contaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {x[0] for x in got}
    edge = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contaminated(edges, bench).collect()}
    assert edge == brute_hits([(r[0], r[1]) for r in edge_rows], items)
    more = [*items[:5], (103, edge_rows[5][1]), (104, edge_rows[9][1][5000:6000]), (None, edge_rows[8][1])]
    edge = sorted(map(str, decontam.contaminated(edges, spark.createDataFrame(more, "item_id bigint, text string")).collect()))
    want = sorted(str((d, i, n, k)) for r in edge_rows for d, i, n, k in brute_hits([(r[0], r[1])], more))
    assert len(edge) == len(want) > 10
    assert decontam.without_contaminated(edges, bench).columns == edges.columns
    assert decontam.contaminated(no_rows, bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_repetitive_and_scattered_items_are_found(spark):
    """Few distinct shingles at many positions in long documents, and items whose shingles are far apart."""
    rng = random.Random(12)
    fresh = iter(range(10**9))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    items = []
    for i, (positions, distinct) in enumerate([(100, 1), (100, 4), (200, 4), (400, 8), (65, 1)] * 8):
        own = words(distinct)
        items.append((i, " ".join((own * (positions + 4))[: positions + 4])))
    items += [(100 + i, " ".join(words(24))) for i in range(5)]
    docs = [(i, " ".join(words(rng.randint(500, 4000)) + t.split() + words(rng.randint(500, 4000)))) for i, t in items]
    for i, t in items[-5:]:
        w = t.split()
        docs.append((200 + i, " ".join(words(2000) + w[:14] + words(2000) + w[10:] + words(2000))))
    docs.append((999, " ".join(words(3000))))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contaminated(df, bench).collect()}
    assert got == brute_hits(docs, items) and {d for d, *_ in got} == {d for d, _ in docs} - {999}
    assert [r.doc_id for r in decontam.without_contaminated(df, bench).collect()] == [999]


@pytest.mark.parametrize(("limit", "most"), [("ITEMS_PER_PASS", 2), ("BYTES_PER_PASS", 70), ("ITEMS_PER_PASS", 100)])
def test_many_items_of_any_id_take_several_passes(spark, monkeypatch, limit, most):
    monkeypatch.setattr(decontam, limit, most)
    items = [(f"item {i}", f"some words of item number {i} here") for i in range(7)]
    docs = [(i, f"before {t} after") for i, (_, t) in enumerate(items)] + [(9, "nothing of that")]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()} == {(i, f"item {i}") for i in range(7)}
    assert [r.doc_id for r in decontam.without_contaminated(df, bench).collect()] == [9]


def test_groups_of_copies_are_whole(spark):
    """A third of all rows in one group of copies."""
    rows = [(i, "one text that stands here very often indeed") for i in range(300)] + [(i, f"text {i} {i * 7} other {i * 13} words {i * 17}") for i in range(300, 900)]
    got = defaultdict(set)
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect():
        got[r.component_id].add(r.doc_id)
    assert got[0] == set(range(300)) and len(got) == 601


def test_tables_of_nodes_are_broadcast_by_their_rows_alone(spark, edges, monkeypatch):
    """Spark sizes them by their files, or before an explode: too low."""
    plans = {}
    write = common.materialize

    def spy(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(components_of, "materialize", spy)
    monkeypatch.setattr(neardup, "materialize", spy)
    monkeypatch.setattr(common, "SMALL_NODES", 0)
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a bigint, b bigint")
    assert {r.component for r in connected_components(links).collect()} == {0}
    assert not any("Broadcast" in p for name in ("nodes", "links", "components") for p in plans[name])
    plans.clear()
    neardup.near_duplicates(edges, width=2)
    assert not any("Broadcast" in p for p in plans["shared"])
