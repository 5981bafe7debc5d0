"""Packing, quality classifier, language models, archives, language identification and the pipeline."""

import base64
import glob
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylvan.llm import common, langid, lmscore, packing, quality, warc

JSON, RANKS = str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def bpe():
    return packing.ByteBpe(JSON, RANKS, P.PATTERN)


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet="aZ é\n\t'sßİ中​1<|endoftext|>", max_size=40))
def test_both_libraries_give_the_same_ids(bpe, s):
    assert list(bpe.ids(s)) == bpe.slow.encode(s, add_special_tokens=False).ids


@given(st.integers(1, 5000), st.integers(1, 300))
def test_cuts(n, capacity):
    got = packing.cut(np.zeros(n), capacity)
    assert [s for s, _ in got] == list(np.cumsum([0, *(k for _, k in got[:-1])])) and sum(k for _, k in got) == n
    assert all(k == capacity for _, k in got[1:]) and 0 < got[0][1] <= capacity


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
def test_plans_use_every_piece_once(histogram):
    used = Counter()
    plan = packing.plan_sequences(histogram, 64)
    for pattern, n in plan:
        assert sum(pattern) <= 64 and n > 0
        for k in pattern:
            used[k] += n
    assert used == Counter(histogram)


def test_plans_are_tight():
    rng = random.Random(1)
    histogram = Counter(min(1024, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(20_000))
    least = math.ceil(sum(k * n for k, n in histogram.items()) / 1024)
    assert sum(n for _, n in packing.plan_sequences(histogram, 1024)) <= 1.005 * least + 1


def test_packing_round_trip(edges, edge_rows, no_rows, bpe):
    got = packing.pack_documents(edges, JSON, RANKS, P.PATTERN).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *(r.length for r in rows[:-1])])) and rows[-1].offset + rows[-1].length <= 1024
    want = Counter()
    for row in edge_rows:
        ids = np.append(np.array(bpe.slow.encode(row[1] or "", add_special_tokens=False).ids, dtype="<u4"), np.uint32(2)).astype("<u4")
        for i, (s, n) in enumerate(packing.cut(ids, 1024)):
            want[(row[0], i, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(no_rows, JSON, RANKS, P.PATTERN).count() == 0


# --- quality ---


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.7
        if not good:
            words = [w + rng.choice(["$$$", "%%%", "***"]) for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words) + ".", 3.0))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double"), spark.createDataFrame(labels, "doc_id bigint, quality int"), dict(labels)


def test_held_out_accuracy(spark, edges, no_rows):
    docs, labels, truth = labelled(spark)
    got = quality.score_quality(docs, labels).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    edge = quality.score_quality(edges, labels.unionByName(labels)).collect()
    assert len(edge) == edges.count() and all(0 <= r.score <= 1 for r in edge)
    assert quality.score_quality(no_rows, labels).count() == 0 and quality.score_quality(docs, labels.limit(0)).count() == 400
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_votes_equal_brute_force():
    rng = random.Random(3)
    texts = [("".join(rng.choice("abc DE!$\n") for _ in range(rng.randint(0, 300)))).encode() for _ in range(120)]
    model = quality.fit_latent(texts[:80], [rng.randint(0, 1) for _ in range(80)], dimensions=10)
    x = model.vectors_of(texts).astype(np.float64)
    for i, score in enumerate(model.scores(texts, block=7)):
        cos = model.vectors.astype(np.float64) @ x[i]
        near = np.argsort(-cos)[: model.neighbours]
        w = np.maximum(cos[near], 0) ** quality.SHARPNESS
        want = (w * model.labels[near]).sum() / w.sum() if w.sum() > 0 and x[i].any() else model.labels.mean()
        assert score == pytest.approx(want, abs=1e-4)


def test_repeats_are_terms():
    got = quality.term_counts([b"a a b a\nx\nx", None, b""])
    assert list(got[0, quality.GROUPS[1] : quality.GROUPS[2]]) == [2, 3, 1] and not got[1:].any()
    assert got[0, quality.GROUPS[2] : quality.GROUPS[3]].sum() == 6 and got[0, quality.GROUPS[3] :].sum() == 5


def test_labels_that_only_the_words_tell():
    """Held-out texts of the same shapes, letters, lengths and marks, which differ in their words alone."""
    rng = random.Random(4)
    letters = lambda: "".join(rng.sample("abcdefghijklmnop", 5))
    common, good, bad = ([letters() for _ in range(n)] for n in (60, 150, 150))

    def text(label):
        own = good if label else bad
        return " ".join(rng.choice(own if rng.random() < 0.3 else common) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(60, 200))).encode()

    labels = [rng.randint(0, 1) for _ in range(500)]
    texts = [text(x) for x in labels]
    model = quality.fit_latent(texts[:300], labels[:300])
    assert np.mean((model.scores(texts[300:]) >= 0.5) == np.array(labels[300:])) > 0.95


# --- language models ---


def brute_losses(docs, target):
    """Of (id, tokens) rows: each one's mean losses in models that have never seen it."""
    out = []
    for at, (i, t) in enumerate(docs):
        others = [(j, u) for k, (j, u) in enumerate(docs) if k != at]
        models = [[u for j, u in others if j in target], [u for _, u in others]]
        size = [sum(len(u) for j, u in docs if m or j in target) for m in range(2)]
        want = []
        for m, texts in enumerate(models):
            scale = size[0] / size[1] if m and size[0] else 1.0
            single = Counter(x for u in texts for x in u)
            pairs = Counter(x for u in texts for x in zip(u[:-1], u[1:], strict=True))
            p = {w: (single[w] * scale + 1) / (sum(single.values()) * scale + 50_257) for w in set(t)}
            loss = -math.log(p[t[0]]) if t else 0.0
            loss -= sum(math.log((pairs[a, w] * scale + lmscore.PSEUDO * p[w]) / (max(0, single[a]) * scale + lmscore.PSEUDO)) for a, w in zip(t[:-1], t[1:], strict=True))
            want.append(loss / max(1, len(t)))
        out.append((i, len(t), *want))
    return out


def test_scores_equal_brute_force(spark, edges, edge_rows, no_rows, bpe):
    labels = spark.createDataFrame([(5, 1), (5, 1), (20, 1), (21, 1), (22, 0), (None, 1), (23, None)], "doc_id bigint, quality int")
    got = sorted(lmscore.score_language(edges, labels, JSON, RANKS, P.PATTERN).collect(), key=str)
    want = sorted(brute_losses([(r[0], bpe.ids(r[1]).tolist() if r[1] else []) for r in edge_rows], {5, 20, 21}), key=lambda x: (str(x[0]), x[1]))
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), want, strict=True):
        assert (r.doc_id, r.n_tokens) == w[:2] and (r.loss_target, r.loss_background) == pytest.approx(w[2:], rel=1e-9) and r.score == pytest.approx(w[2] - w[3], abs=1e-9)
    assert lmscore.score_language(no_rows, labels, JSON, RANKS, P.PATTERN).count() == 0
    assert lmscore.score_language(edges, labels.limit(0), JSON, RANKS, P.PATTERN).count() == len(edge_rows)


@pytest.mark.parametrize("small", [1_000_000, 5])
def test_pairs_have_counts_of_their_own(spark, bpe, monkeypatch, small):
    """Losses from exact pair counts.  Documents fall into several blocks, one
    is longer than a block, and the labels are merged where they are many."""
    ids = np.arange(1500)
    keys = lmscore.pair_keys(np.stack([np.repeat(ids, 1500), np.tile(ids, 1500)], axis=1).ravel())[::2]
    assert len(np.unique(keys)) == len(keys) == 1500**2
    monkeypatch.setattr(lmscore, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["the", "of", "cat", "sat", "on", "é", "mat"]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    docs.append((60, " ".join(rng.choice("abcdefgh") for _ in range(1500))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = lmscore.score_language(df, spark.createDataFrame([(i, 1 - i % 2) for i in range(61)], "doc_id bigint, quality int"), JSON, RANKS, P.PATTERN).collect()
    want = {w[0]: w[1:] for w in brute_losses([(i, bpe.ids(t).tolist()) for i, t in docs], set(range(0, 61, 2)))}
    assert sorted(r.doc_id for r in got) == list(range(61))
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and (r.loss_target, r.loss_background) == pytest.approx(want[r.doc_id][1:], rel=1e-9)


def test_a_long_text_is_counted_in_parts(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 9, 1000).astype("<u2")
    whole = lmscore.pairs_of(ids)
    monkeypatch.setattr(lmscore, "BLOCK_TOKENS", 7)
    assert all((a == b).all() for a, b in zip(whole, lmscore.pairs_of(ids), strict=True)) and whole[1].sum() == 999
    assert all(not len(x) for x in lmscore.pairs_of(ids[:1]))


def test_documents_that_occur_twice_stand_apart(spark):
    """Scored without itself, a text that is there twice is known, one that is there once isn't."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(2000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(200)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]
    got = lmscore.score_language(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, 1) for i in range(0, 200, 3)], "doc_id bigint, quality int"), JSON, RANKS, P.PATTERN).collect()
    twice = [r.loss_background for r in got if r.doc_id >= 1000 or r.doc_id < 20]
    once = [r.loss_background for r in got if 20 <= r.doc_id < 1000]
    assert max(twice) < min(once)


# --- archives ---


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.example.org/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "x\ny", "<p>1</p>"), (None, "n", "only null ids"), (3, "http://again", "<p>3</p>" * 3), (70, "long", "é" * 400_000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_archives_round_trip(spark, pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in rows:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    for least in (0, 30):
        want = Counter()
        for i, b in rows:
            to = first.get(b) if len(b) >= least and first.get(b) != i else None
            want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to)] += 1
        assert Counter(tuple(r) for r in warc.archive_pages(pages, least).collect()) == want
    empty = pages.limit(0)
    assert warc.archive_pages(empty).count() == 0


def test_one_record_costs_one_frame(spark, pages, tmp_path):
    bundles = warc.write_bundles(pages, frame_bytes=500, bundle_bytes=2000)
    rows = bundles.collect()
    assert len(rows) > 1
    for b in rows:
        content = bytes(b.content)
        whole = b"".join(zstandard.ZstdDecompressor().decompress(content[a : a + n], max_output_size=m) for a, n, m in warc.seek_table(content))
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(content) == whole
        for x in b.records:
            record = warc.read_record(content, x.frame, x.start, x.length)
            assert warc.parse_record(record)[0]["WARC-Record-ID"] == f"<{x.record_id}>" and record in whole
    names = [x.record_id for b in rows for x in b.records]
    assert len(names) == len(set(names)) == pages.count()  # repeated and null ids, too
    wanted = [n for n in names if n in ("urn:page:61", "urn:page:70", "urn:page:5") or "#" in n]
    found = warc.find_records(bundles, spark.createDataFrame([(n,) for n in [*wanted, wanted[0], "urn:page:nobody", None]], "record_id string")).collect()
    assert sorted(r.record_id for r in found) == sorted(wanted) and len(wanted) == 3 + 4
    assert next(bytes(r.payload) for r in found if r.record_id == "urn:page:70") == ("é" * 400_000).encode()
    files = warc.export(bundles, str(tmp_path))
    assert files.count() == len(rows) == len(glob.glob(f"{tmp_path}/*.warc.zst"))


# --- languages ---


def test_evidence():
    assert langid.host_parts("https://u:p@A.b.Example.CO:80/x") == ("a.b.example.co", "example.co", "co")
    assert langid.host_parts("nothing") == langid.host_parts(None) == (None, None, None)
    assert langid.declared_language('<html class=x lang="DE-at">') == "de" and langid.declared_language("<p lang=de>") is None
    assert langid.declared_language('<meta http-equiv="Content-Language" content="fr">') == "fr"
    assert langid.visible_text("<head>x</head>a<!-- b --><script>c</script>&eacute;").split() == ["a", "é"]


def test_fusion(spark):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["schl", "ung", "ich"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(2)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(lang, 50), lang) for i, lang in enumerate(["aa", "bb"] * 40)], "doc_id bigint, text string, lang string")
    rows, truth = [], {}
    for i in range(200):
        lang = rng.choice(["aa", "bb"])
        truth[i] = lang
        mark = lang if rng.random() < 0.9 else "aa"
        rows.append((i, f"http://h{i % 4}.{lang}.example/{i}", f'<html lang="{mark}"><body>{text(lang, rng.choice([1, 3, 40]))}</body></html>'))
    for i in range(200, 220):  # no text: the host decides
        truth[i] = "bb"
        rows.append((i, "http://h0.bb.example/x", "<html></html>"))
    rows += [(300, None, None), (301, "odd", ""), (None, "http://h0.aa.example/", "<p>ka</p>"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = langid.identify_pages(pages, docs).collect()
    assert len(got) == len(rows) and all(0 < r.confidence <= 1 for r in got)
    assert np.mean([r.lang == truth[r.page_id] for r in got if r.page_id in truth]) > 0.98
    by = {r.page_id: r for r in got}
    assert by[300].text_lang is None and by[300].host is None and by[300].lang in ("aa", "bb")
    assert langid.identify_pages(pages.limit(0), docs).count() == 0
    assert langid.identify_pages(pages, docs.limit(0)).count() == len(rows)
    mixed = docs.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    both = langid.identify(pages, mixed).collect()
    assert len(both) == len(rows) + 80 and all((r.doc_id is None) or r.lang == ["aa", "bb"][r.doc_id % 2] for r in both)


def test_every_language_takes_part(spark):
    """More than 64 languages, and a rare one that a sample by hash alone leaves out."""
    rng = random.Random(11)
    langs = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopq"]
    parts = {lang: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(4)] for lang in [*langs, "zz"]}
    text = lambda lang: " ".join(rng.choice(parts[lang]) for _ in range(40))
    model = langid.TextModel([langid.packed_trigrams(text(lang).encode()) for lang in langs], langs)
    assert model.langs == sorted(langs) and len(langs) == 70
    assert [model.langs[int(model.likelihoods(text(lang).encode()).argmax())] for lang in langs] == langs
    rows = [(i, text("ak"), "ak") for i in range(300)] + [(1000, text("zz"), "zz"), (1001, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learnt = langid.learn_texts(df, 5)
    assert learnt.langs == ["ak", "zz"] and learnt.likelihoods(text("zz").encode()).argmax() == 1
    docs = spark.createDataFrame([(i, text(lang), lang, "s" + lang) for i, lang in enumerate(langs * 2)], "doc_id bigint, text string, lang string, source string")
    got = langid.identify(None, docs, 20).collect()
    assert len(got) == 140 and all(r.lang == (langs * 2)[r.doc_id] for r in got)


def test_posteriors_equal_brute_force(spark):
    """The fusion of all evidence, in plain Python, for pages with ties, nulls and repeats and for documents."""
    rng = random.Random(21)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["schl", "ung", "ich"], "cc": ["oo", "ka", "ung"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(2)) for _ in range(n))
    langs = sorted(syllables)
    model = langid.TextModel([langid.packed_trigrams(text(x, 60).encode()) for x in langs * 5], langs * 5)
    pages = []
    for i in range(60):
        x = rng.choice(langs)
        mark = rng.choice([f' lang="{rng.choice(langs)}"', f' lang="{x}"', ""])
        url = rng.choice([f"http://h{i % 3}.{x}.example/{i}", f"https://h{i % 2}.d{i % 3}.org/", "odd", None])
        pages.append((i, url, rng.choice([f"<html{mark}><body>{text(x, rng.choice([0, 1, 5]))}</body></html>"] * 4 + [None, ""])))
    pages += [pages[0], pages[0], (None, "http://h0.aa.example/", "ka")]
    docs = [(i, text(rng.choice(langs), rng.choice([0, 1, 4])) or None, rng.choice(["s1", "s2", None])) for i in range(30)]
    said = []
    for i, url, body in pages:
        host, domain, suffix = langid.host_parts(url)
        said.append((None, i, host, domain, suffix, langid.declared_language(body or ""), model.likelihoods(langid.visible_text(body or "").encode())))
    for i, body, source in docs:
        said.append((i, None, source and "source:" + source, source and "source:", None, None, model.likelihoods((body or "").encode())))
    share = [np.exp(x[-1]) / np.exp(x[-1]).sum() for x in said]
    n = len(langs)
    prior = (sum(share) + 1) / (len(said) + n)

    def others(k, at, column):
        """Count and shares of all rows that have this row's value, without its own."""
        value = said[at][column]
        same = [share[j] for j in range(len(said)) if value is not None and j != at and said[j][column] == value]
        return len(same), sum(same, np.zeros(n))

    want = []
    for at, x in enumerate(said):
        domain_n, domain = others(n, at, 3)
        base = (domain + langid.PSEUDO * prior) / (domain_n + langid.PSEUDO)
        host_n, host = others(n, at, 2)
        score = x[-1] + np.log((host + langid.PSEUDO * base) / (host_n + langid.PSEUDO))
        for column in (5, 4):
            k, sums = others(n, at, column)
            score = score + np.log((sums + langid.PSEUDO * prior) / (k + langid.PSEUDO) / prior)
        p = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        want.append((str(x[0]), str(x[1]), langs[int(p.argmax())], float(p.max()), langs[int(x[-1].argmax())] if (x[-1] < 0).any() else None))
    got = langid.identify(
        spark.createDataFrame(pages, "page_id bigint, url string, html string"), spark.createDataFrame([(*d, "aa") for d in docs], "doc_id bigint, text string, source string, lang string"), model=model
    ).collect()
    got = sorted((str(r.doc_id), str(r.page_id), r.lang, r.confidence, r.text_lang) for r in got)
    for g, w in zip(got, sorted(want, key=lambda w: (w[0], w[1], w[2], w[3])), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-6) and g[4] == w[4]


def test_samples_are_stratified(spark):
    """A language of few texts, one of an id with two languages, and repeated rows: always the same model."""
    rng = random.Random(3)
    rows = [(i, f"text {rng.random()} of aa", "aa") for i in range(900)] + [(1000 + i, f"bb words {rng.random()}", "bb") for i in range(30)] + [(2000, "twice", "cc"), (2000, "twice", "bb"), (2000, "twice", "cc"), (2001, None, "dd"), (None, "x", "ee")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sizes = []
    for parts in (1, 7):
        model = langid.learn_texts(df.repartition(parts), 60)
        assert model.langs == ["aa", "bb"]  # an id's first language by name counts
        sizes.append(model.log_p)
    assert (sizes[0] == sizes[1]).all()


# --- the pipeline ---


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Near duplicates, contaminated documents and secrets, against plain loops over sets and characters."""
    import corpus_pipeline

    from test_sets import brute, brute_hits
    from test_texts import brute_added, brute_base

    rng = random.Random(19)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "st", "re"]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 30)))) for i in range(6)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(50)]
    for _ in range(60):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randint(0, len(w)) :][:1] = []
            w.insert(rng.randint(0, len(w)), rng.choice([word(), rng.choice(items)[1], "Kx7" + "".join(rng.choice("abcXYZ0123456789") for _ in range(40)), "token=" + "ab12" * 9]))
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, "en", "s", None), (501, "", "en", "s", 0), (None, texts[3], "en", None, 1), (7, texts[8], "en", "s", 1)]
    rows += [rows[2], rows[2]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    # Each row a document of its own: of rows that repeat an id and a text, the first.
    distinct = list({(r[0], r[1]) if r[0] is not None else ("null", k): r for k, r in reversed(list(enumerate(rows)))}.values())
    at, _ = brute([(k, r[1]) if r[0] is not None else (None, None) for k, r in enumerate(distinct)], 5)
    least = {}
    for k, r in enumerate(distinct):
        if r[0] is not None:
            least[at[k]] = min(least.get(at[k], r[0]), r[0])
    kept = [r for k, r in enumerate(distinct) if r[0] is None or least[at[k]] == r[0]]
    key = lambda r: (str(r[0]), str(r[1]))
    docs = stages["near_dedup"](spark, docs, str(tmp_path))
    assert sorted(map(key, docs.collect())) == sorted(map(key, kept))
    kept = [r for r in kept if not brute_hits([(0, r[1])], items)]
    docs = stages["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert sorted(map(key, docs.collect())) == sorted(map(key, kept)) and len(kept) > 20
    masked = []
    for r in kept:
        spans = sorted((a, b) for _, a, b in brute_base(r[1] or "") + brute_added(r[1] or ""))
        out, end = "", 0
        for a, b in spans:
            if a >= end:
                out += r[1][end:a] + "[secret]"
            end = max(end, b)
        masked.append((r[0], r[1] and out + r[1][end:]))
    docs = stages["secret_scans"](spark, docs, str(tmp_path))
    assert sorted(map(key, docs.collect())) == sorted(map(key, masked)) and masked != [r[:2] for r in kept]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())


def test_pipeline(spark, edges, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "st", "re"]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    clean = {i: " ".join(word() for _ in range(80)) + "." for i in range(100)}
    rows = dict(clean)
    rows[200] = clean[3] + " and a bit more"
    rows[201] = clean[4]
    rows[202] = " ".join(word() for _ in range(40)) + " " + items[2][1]
    rows[203] = " ".join(word() for _ in range(60)) + ' token = "' + "0123456789abcdef0f" * 2 + '" end.'
    junk = {i: " ".join(word() + "$$$" for _ in range(80)) for i in range(300, 340)}
    rows |= junk
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id: r.text for r in docs.collect()})
    assert set(left[0]) == set(rows) - set(junk)
    assert set(left[1]) == set(left[0]) - {200, 201}
    assert set(left[2]) == set(left[1]) - {202}
    assert set(left[3]) == set(left[2]) and "[secret]" in left[3][203] and all(left[3][i] == clean[i] for i in clean)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == set(left[3])
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edges, str(tmp_path)).count()
