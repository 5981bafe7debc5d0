"""Quality classifier (operator 2): nearest-neighbour voting over
latent-semantic vectors.

A bounded sample of labelled texts gives a term matrix, whose truncated
singular value decomposition (found by power iteration) spans the latent
space.  The sample's vectors are broadcast; every document takes the exact
cosine with all of them, in blocks, and its nearest neighbours vote with their
similarities as weights.

Terms are of four groups: the words of a text and its pairs of neighbouring
words, hashed, which tell what it says; trigrams over 16 classes of bytes, which
tell how it is written; and counts of repeats.  Each group is scaled so that it
has the same share in the sample's vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts, mix, word_hashes

#: Labelled texts to learn from, at most; with 48 numbers each they are under 1 MB.
SAMPLE = 3000
DIMENSIONS = 48
NEIGHBOURS = 25
#: A neighbour's vote is its similarity to this power.
SHARPNESS = 8


def _classes() -> np.ndarray:
    """The class of each byte: lower, upper, digits, blanks, line ends, bytes
    of other than ASCII, and the frequent marks one by one."""
    out = np.full(256, 15, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[0x20, 0x09]] = 3
    out[[0x0A, 0x0D]] = 4
    out[0x80:] = 5
    for k, marks in enumerate((".", ",", "!?", "#@", "$%&*", "|_~", "'\"", "-", "()[]{}<>/\\"), start=6):
        for m in marks:
            out[ord(m)] = k
    return out


_CLASS = _classes()
_N = 16**3
#: Places that words, and pairs of words, are hashed to.
WORDS = 1 << 12
#: Where each group of terms begins: trigrams, repeats (words equal to the one
#: before, words seen within the last 16, lines seen before), words, pairs.
GROUPS = (0, _N, _N + 3, _N + 3 + WORDS, _N + 3 + 2 * WORDS)
TERMS = GROUPS[-1]


def term_counts(texts: list[bytes | None]) -> np.ndarray:
    """A row of term counts for each text."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
    if sizes.sum():
        c = _CLASS[np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)]
        doc = np.repeat(np.arange(len(texts)), sizes)
        tri = (c[:-2] * 16 + c[1:-1]) * 16 + c[2:]
        inside = doc[:-2] == doc[2:]
        out[:, :_N] = np.bincount((doc[:-2] * _N + tri)[inside], minlength=len(texts) * _N).reshape(-1, _N)
    words: list[bytes] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            own = t.lower().split()
            n[i] = len(own)
            words += own
            lines = [x for x in t.split(b"\n") if x.strip()]
            out[i, _N + 2] = len(lines) - len(set(lines))
    if words:
        coded = pa.array(words, type=pa.binary()).dictionary_encode()
        ids = np.asarray(coded.indices)
        doc = np.repeat(np.arange(len(texts)), n)
        near = np.zeros(len(ids), dtype=bool)
        for k in range(1, 17):
            same = (ids[k:] == ids[:-k]) & (doc[k:] == doc[:-k])
            near[k:] |= same
            if k == 1:
                out[:, _N] = np.bincount(doc[1:][same], minlength=len(texts))
        out[:, _N + 1] = np.bincount(doc[near], minlength=len(texts))
        h = word_hashes(coded.dictionary.to_pylist())[ids]
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
        inside = doc[:-1] == doc[1:]
        for at, of, g in ((doc, h, 2), (doc[:-1][inside], pair[inside], 3)):
            places = at * WORDS + (of >> np.uint64(40)).astype(np.int64) % WORDS
            out[:, GROUPS[g] : GROUPS[g + 1]] = np.bincount(places, minlength=len(texts) * WORDS).reshape(-1, WORDS)
    return out


@dataclass
class LatentModel:
    """The latent space and the labelled vectors in it."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def vectors_of(self, texts: list[bytes | None]) -> np.ndarray:
        return self.unit(_scaled(term_counts(texts), self.weights))

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Weighted terms in the latent space, with length 1."""
        x = x @ self.basis
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)).astype(np.float32)

    def scores(self, texts: list[bytes | None], block: int = 512) -> np.ndarray:
        """Between 0 and 1; a text without terms gets the sample's mean label."""
        base = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), base)
        if not len(self.labels):
            return out
        x = self.vectors_of(texts)
        k = min(self.neighbours, len(self.labels))
        for start in range(0, len(texts), block):
            own = x[start : start + block]
            cos = own @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = w.sum(axis=1)
            vote = (w * self.labels[near]).sum(axis=1)
            some = (total > 0) & own.any(axis=1)
            out[start : start + block][some] = np.clip(vote[some] / total[some], 0, 1)
        return out


def _parts(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[list[bytes | None]]:
    """Lists of texts of at most ``most`` bytes, so that little is counted at once."""
    part, size = [], 0
    for t in texts:
        if part and (size + len(t or b"") > most or len(part) == 64):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or b"")
    if part:
        yield part


def _scaled(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares, which a text's length doesn't change, weighted."""
    out = np.empty_like(counts)
    for g in range(4):
        of = 0 if g < 2 else g  # repeats are shares of the bytes
        total = counts[:, GROUPS[of] : GROUPS[of + 1]].sum(axis=1, keepdims=True)
        group = slice(GROUPS[g], GROUPS[g + 1])
        np.divide(counts[:, group], np.maximum(total, 1), out=out[:, group])
    return np.sqrt(out, out=out) * weights


def packed_terms(texts: list[bytes | None]) -> list[bytes]:
    """The unweighted terms of each text: places of two bytes, then values of four."""
    out = []
    for part in _parts(texts):
        for row in _scaled(term_counts(part), np.ones(TERMS, dtype=np.float32)):
            at = np.flatnonzero(row)
            out.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
    return out


def fit_latent(texts: list[bytes | None], labels: list[int], dimensions: int = DIMENSIONS) -> LatentModel:
    return fit_terms(packed_terms(texts), labels, dimensions)


def fit_terms(terms: list[bytes], labels: list[int], dimensions: int = DIMENSIONS, seed: int = 7) -> LatentModel:
    """Term weights, the latent basis and the sample's vectors in it."""
    x = np.zeros((len(terms), TERMS), dtype=np.float32)
    for row, t in zip(x, terms, strict=True):
        n = len(t) // 6
        row[np.frombuffer(t, dtype="<u2", count=n)] = np.frombuffer(t, dtype="<f4", offset=2 * n)
    weights = (1 + np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1))).astype(np.float32)
    x *= weights
    for begin, end in zip(GROUPS, GROUPS[1:], strict=False):
        norm = float(np.sqrt((x[:, begin:end] ** 2).sum() / max(1, len(x))))
        if norm > 0:
            weights[begin:end] /= norm
            x[:, begin:end] /= norm
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((TERMS, min(dimensions + 8, TERMS))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q)) if len(x) else (q, None)
    _, _, v = np.linalg.svd(x @ q, full_matrices=False) if len(x) else (None, None, np.eye(q.shape[1]))
    model = LatentModel(weights, q @ v[:dimensions].T, np.zeros((0, 0), np.float32), np.array(labels, dtype=np.float64))
    model.vectors = model.unit(x)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is for testing: the CRC-32 of its id as text is a multiple of 5."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def labelled_sample(df: DataFrame, labels: DataFrame, label_col: str = "quality", n: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> tuple[list[bytes], list[int]]:
    """The terms and labels of at most ``n`` texts that aren't held out, chosen
    by hash of their ids.  The ids are chosen first, so that only a sample's
    texts are read further; and only their terms, at most 75 kB each, reach the
    driver, however long the texts are."""
    of = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("id is not null and label is not null").where(~held_out("id"))
    chosen = of.groupBy("id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(n)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")  # chosen has at most n rows
    rows = map_texts(texts, "text", ["id", "label"], "terms binary", lambda t: [pa.array(packed_terms(t), pa.binary())]).dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: r.id)
    return [bytes(r.terms) for r in rows], [r.label for r in rows]


def score_quality(df: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted.

    A null or empty text has no terms and gets the mean label of the sample; a
    null id is handed on and not held out; repeated rows give repeated results.
    Of several labels of one id the largest counts.
    """
    model = fit_terms(*labelled_sample(df, labels, n=sample, text_col=text_col, id_col=id_col))
    got = map_texts(df, text_col, [id_col], "score double", lambda texts: [pa.array(np.concatenate([model.scores(part) for part in _parts(texts)]))])
    return got.select(F.col(f"`{id_col}`"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose score reaches ``threshold``, with their columns."""
    model = fit_terms(*labelled_sample(df, labels, n=sample, text_col=text_col, id_col=id_col))
    name = fresh(df, "score")
    got = map_texts(df, text_col, df.columns, f"`{name}` double", lambda texts: [pa.array(np.concatenate([model.scores(part) for part in _parts(texts)]))])
    return got.where(F.col(f"`{name}`") >= threshold).select(*[f"`{c}`" for c in df.columns])
