"""Language identification (operator 8): Bayesian evidence fusion.

For every page the log likelihoods of its visible text under each language (a
naive Bayes over hashed byte trigrams) are added to the log likelihoods of the
declared markup language and of the address suffix, and to a prior of its host.
How far declarations and suffixes can be trusted, and the priors, come from the
pages themselves, by grouped sums of what their texts say; a host's prior is
smoothed by its domain's and that by the corpus's, without the page's own
share.  Plain documents take part with their text and with the prior of their
source, which stands for a host.
"""

from __future__ import annotations

import html
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, discard, map_texts, materialize, mix, small_side

#: Labelled texts that the likelihoods are learnt from, at most, unless there
#: are more languages: each has a text at least, and all have as many where
#: they can.  The likelihoods take 256 kB for each language.
SAMPLE = 2000
BUCKETS = 1 << 16
#: Trigrams overlap and repeat: a text counts as at most so many independent ones.
EVIDENCE = 60.0
#: Pages that the level above counts for, in a prior.
PSEUDO = 5.0

_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|nav|head)\b.*?</\1\s*>|<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_META = re.compile(r"""(?is)<meta\b[^>]*?content-language["']?[^>]*?content\s*=\s*["']?\s*([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def visible_text(page: str) -> str:
    return html.unescape(_HIDDEN.sub(" ", page))


def declared_language(page: str) -> str | None:
    m = _DECLARED.search(page) or _META.search(page)
    return m[1].lower() if m else None


def host_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (its last label)."""
    m = _HOST.match(url) if url else None
    if not m:
        return None, None, None
    host = m[1].lower().strip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def trigram_buckets(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", dtype=np.uint8).astype(np.uint64)
    if len(b) < 4:
        return np.zeros(0, dtype=np.int64)
    return (mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def packed_trigrams(text: bytes | None) -> bytes:
    """A text's trigram counts: buckets of two bytes, then counts of four."""
    at, n = np.unique(trigram_buckets(text or b""), return_counts=True)
    return at.astype("<u2").tobytes() + n.astype("<u4").tobytes()


class TextModel:
    """Log probabilities of the trigram buckets in each language."""

    def __init__(self, trigrams: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(self.langs)}
        counts = np.full((len(self.langs), BUCKETS), 0.1)
        for t, lang in zip(trigrams, langs, strict=True):
            n = len(t) // 6
            counts[place[lang], np.frombuffer(t, dtype="<u2", count=n)] += np.frombuffer(t, dtype="<u4", offset=2 * n)
        self.log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def likelihoods(self, text: bytes) -> np.ndarray:
        """Log likelihoods relative to the best language, tempered to EVIDENCE trigrams."""
        at = trigram_buckets(text)
        if not len(at) or not self.langs:
            return np.zeros(len(self.langs))
        ll = self.log_p[:, at].sum(axis=1, dtype=np.float64) * min(1.0, EVIDENCE / len(at))
        return ll - ll.max()


def learn_texts(documents: DataFrame, n: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> TextModel:
    """Learn from at most ``n`` labelled texts, or as many as there are
    languages, if that is more: of each language the same number, chosen by
    hash of their ids, or all that it has.

    Of an id with several languages the first by name counts, and of one with
    several texts the first by its trigrams.
    """
    columns = F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang")
    labelled = documents.where(F.length(F.trim(f"`{text_col}`")) > 0).select(*columns).where("id is not null and lang is not null")
    labelled = labelled.withColumn("h", F.xxhash64("id"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"), F.min(F.struct("h", "id")).alias("first"))
    sizes = materialize(sizes, "languages")  # one row for each language
    quota = max(1, n // max(1, sizes.count()))
    # About twice the quota passes by hash, so that no language's rows all meet in one task to be ranked.
    passed = labelled.join(small_side(sizes), "lang").where((F.pmod("h", F.lit(1 << 30)) < (1 << 30) * 2.0 * quota / F.col("size")) | (F.col("id") == F.col("first.id")))
    ranked = passed.select("id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")).alias("rank"))
    chosen = ranked.where(F.col("rank") <= quota).groupBy("id").agg(F.min("lang").alias("lang"))
    texts = documents.select(columns[0], F.col(f"`{text_col}`").alias("text")).where("text is not null").join(F.broadcast(chosen), "id")  # at most n rows, or one for each language
    count = lambda texts: [pa.array([packed_trigrams(t) for t in texts], pa.binary())]
    rows = map_texts(texts, "text", ["id", "lang"], "trigrams binary", count).groupBy("id").agg(F.min("lang").alias("lang"), F.min("trigrams").alias("trigrams")).collect()  # at most 400 kB each
    discard(sizes)
    rows.sort(key=lambda r: r.id)
    return TextModel([bytes(r.trigrams) for r in rows], [r.lang for r in rows])


_SAID = "host string, domain string, suffix string, declared string, ll array<double>"


def page_evidence(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(doc_id, page_id, host, domain, suffix, declared, ll): what each page says by itself."""

    def one(url: bytes | None, body: bytes | None) -> tuple:
        page = (body or b"").decode("utf-8", "replace")
        return *host_parts(url.decode("utf-8", "replace") if url else None), declared_language(page), model.likelihoods(visible_text(page).encode("utf-8", "replace"))

    return _evidence(pages.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("at"), F.col(f"`{html_col}`").alias("body")), one)


def document_evidence(documents: DataFrame, model: TextModel, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The same of documents: their source is host and domain."""

    def one(source: bytes | None, body: bytes | None) -> tuple:
        host = "source:" + source.decode("utf-8", "replace") if source is not None else None
        return host, host and "source:", None, None, model.likelihoods(body or b"")

    return _evidence(documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"), F.col(f"`{source_col}`").alias("at"), F.col(f"`{text_col}`").alias("body")), one)


def _evidence(rows: DataFrame, one) -> DataFrame:
    picked = rows.withColumns({c: F.col(c).cast("binary") for c in ("at", "body")})
    schema = T.StructType([*picked.schema.fields[:2], *T.StructType.fromDDL(_SAID).fields])
    names = schema.fieldNames()

    def evidence(batches):
        for b in batches:
            for start, n in byte_slices(b.column(3)):
                got = [one(at, body) for at, body in zip(b.column(2).slice(start, n).to_pylist(), b.column(3).slice(start, n).to_pylist(), strict=True)]
                columns = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, n), b.column(1).slice(start, n), *(pa.array(c, pa.string()) for c in columns[:4]), pa.array([x.tolist() for x in columns[4]], pa.list_(pa.float64()))], names=names
                )

    return picked.mapInArrow(evidence, schema)


def _sums(df: DataFrame, key: str, langs: range, stem: str) -> DataFrame:
    """For each key: how many pages, and how much of them each language has."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"{stem}_n"), *[F.sum(f"p{i}").alias(f"{stem}_{i}") for i in langs])


def identify(pages: DataFrame | None, documents: DataFrame, sample: int = SAMPLE, model: TextModel | None = None, with_documents: bool = True) -> DataFrame:
    """One row per page and document: doc_id (null for pages), page_id (null
    for documents), lang, confidence, text_lang, declared_lang, suffix, host.

    A null or empty text says nothing, a null or odd url has no host: the prior
    then decides.  Ties go to the first language by name.  A null id is handed
    on; repeated rows count as often as they stand there.  Every language that
    a labelled text is in takes part, however many there are.  Without labelled
    texts to learn from, lang is null.
    """
    model = model or learn_texts(documents, sample)
    langs = model.langs
    parts = [page_evidence(pages, model)] if pages is not None else []
    parts += [document_evidence(documents, model)] if with_documents else []
    said = reduce(DataFrame.unionByName, parts)
    if not langs:
        return said.selectExpr("doc_id", "page_id", "cast(null as string) lang", "0D confidence", "cast(null as string) text_lang", "declared declared_lang", "suffix", "host")
    k = range(len(langs))
    total = reduce(lambda a, b: a + b, [F.exp(F.col("ll")[i]) for i in k])
    said = materialize(said.select("doc_id", "page_id", "host", "domain", "suffix", "declared", *[F.col("ll")[i].alias(f"ll{i}") for i in k], *[(F.exp(F.col("ll")[i]) / total).alias(f"p{i}") for i in k]), "evidence")

    every = said.agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"s{i}") for i in k]).first()
    prior = [((every[f"s{i}"] or 0.0) + 1) / (every["n"] + len(langs)) for i in k]
    hosts = said.where("host is not null").groupBy("host").agg(F.first("domain").alias("domain"), F.count("*").alias("h_n"), *[F.sum(f"p{i}").alias(f"h_{i}") for i in k])
    domains = hosts.groupBy("domain").agg(F.sum("h_n").alias("d_n"), *[F.sum(f"h_{i}").alias(f"d_{i}") for i in k])
    # Written, so that the join with the pages has exchanges of its own, whose hot keys Spark can split.
    hosts = materialize(hosts.join(domains, "domain").drop("domain"), "hosts")
    marks = [_sums(said, "declared", k, "m"), _sums(said, "suffix", k, "x")]
    joined = said.join(hosts, "host", "left").join(marks[0], "declared", "left").join(marks[1], "suffix", "left")

    def others(stem: str, i: int | str) -> Column:
        """A sum without the page's own share."""
        own = F.lit(1.0) if i == "n" else F.col(f"p{i}")
        return F.greatest(F.coalesce(F.col(f"{stem}_{i}") - own, F.lit(0.0)), F.lit(0.0))

    def posterior(i: int) -> Column:
        base = F.lit(prior[i])
        domain = (others("d", i) + PSEUDO * base) / (others("d", "n") + PSEUDO)
        host = (others("h", i) + PSEUDO * domain) / (others("h", "n") + PSEUDO)
        out = F.col(f"ll{i}") + F.log(host)
        for stem in ("m", "x"):  # P(mark | language) is proportional to P(language | mark) / P(language)
            of_mark = (others(stem, i) + PSEUDO * base) / (others(stem, "n") + PSEUDO)
            out = out + F.log(of_mark / base)
        return out

    def best(stem: str) -> Column:
        return F.array_max(F.array(*[F.struct(F.col(f"{stem}{i}").alias("v"), F.lit(-i).alias("o"), F.lit(langs[i]).alias("lang")) for i in k]))

    scored = joined.select("doc_id", "page_id", "host", "suffix", "declared", *[F.col(f"ll{i}") for i in k], *[posterior(i).alias(f"q{i}") for i in k])
    top = F.greatest(*[F.col(f"q{i}") for i in k]) if len(langs) > 1 else F.col("q0")
    mass = reduce(lambda a, b: a + b, [F.exp(F.col(f"q{i}") - top) for i in k])
    some_text = reduce(lambda a, b: a | b, [F.col(f"ll{i}") < 0 for i in k])
    return scored.select(
        "doc_id",
        "page_id",
        best("q")["lang"].alias("lang"),
        (F.lit(1.0) / mass).alias("confidence"),
        F.when(some_text, best("ll")["lang"]).alias("text_lang"),
        F.col("declared").alias("declared_lang"),
        "suffix",
        "host",
    )


def identify_pages(pages: DataFrame, documents: DataFrame, sample: int = SAMPLE, model: TextModel | None = None) -> DataFrame:
    """:func:`identify` of pages alone."""
    return identify(pages, documents, sample, model, with_documents=False).drop("doc_id")
