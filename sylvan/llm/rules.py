"""Quality rules (operator 6): tokeniser fertility.

A public vocabulary encodes every text; characters per token, the share of
byte-fallback tokens and the entropy of the tokens show text that the
vocabulary's languages don't look like.  Bands are kept per script, and per
language where a language needs its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .tokens import PieceCounter

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Band:
    """Texts outside are rejected.  Entropy (bits per token) is judged from
    ``least_tokens`` tokens on, as a short text can't have much of it."""

    chars_per_token: tuple[float, float]
    most_fallback: float
    entropy: tuple[float, float]
    least_tokens: int = 100


#: By script.  Measured for Latin script on labelled texts of 50 words and more
#: in four languages: 3,243 good ones have 1.97 to 2.83 characters a token, no
#: fallback and 5.55 to 7.1 bits a token; of 548 bad ones, 39 per cent lie below
#: 5 bits.  The band leaves half a bit below the least of the good ones, and room
#: for other prose, which has up to five characters a token.  No labelled texts
#: of other scripts were at hand: their bands only keep out what the vocabulary
#: can't say anything of.
BANDS = {
    "latin": Band((1.9, 7.0), 0.10, (5.0, 12.0)),
    "cyrillic": Band((1.2, 6.0), 0.15, (4.5, 12.0)),
    "greek": Band((0.8, 5.0), 0.30, (4.0, 12.0)),
    "cjk": Band((0.3, 3.0), 0.80, (4.0, 12.0)),
    "other": Band((0.25, 7.0), 1.0, (3.0, 12.0)),
}


def script_of(text: str) -> str:
    """The script of most letters, by code point ranges."""
    if text.isascii():
        return "latin"
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    low = cp | 0x20
    latin = int((((low >= 0x61) & (low <= 0x7A)) | ((cp >= 0xC0) & (cp <= 0x24F))).sum())
    greek = int(((cp >= 0x370) & (cp <= 0x3FF)).sum())
    cyrillic = int(((cp >= 0x400) & (cp <= 0x52F)).sum())
    cjk = int((((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0xAC00) & (cp <= 0xD7AF))).sum())
    other = int((cp >= 0x250).sum()) - greek - cyrillic - cjk
    return max((latin, "latin"), (cyrillic, "cyrillic"), (greek, "greek"), (cjk, "cjk"), (other, "other"))[1]


def repeated_window_words(words: list[bytes], counts: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text, the words that stand in a ``k``-word window found twice
    or more in that text.  ``counts``: words of each text."""
    out = np.zeros(len(counts), dtype=np.int64)
    if not words:
        return out
    coded = pa.array(words, type=pa.binary()).dictionary_encode()
    ids = np.asarray(coded.indices).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(ids) - k + 1
    if n <= 0:
        return out
    key = ids[:n].copy()
    for j in range(1, k):  # renumbered at each step, so that no product overflows
        key = key * len(coded.dictionary) + ids[j : j + n]
        if j + 1 < k and len(coded.dictionary) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
    inside = doc[:n] == doc[k - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    hit = np.zeros(len(ids), dtype=bool)
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    for j in range(k):
        hit[twice + j] = True
    return np.bincount(doc[hit], minlength=len(counts)).astype(np.int64)


class Fertility:
    def __init__(self, path: str):
        self.count = PieceCounter(path)
        model = self.count.model
        n = model.get_piece_size()
        #: Bytes that are white space have no piece in some vocabularies and say nothing about the script.
        self.fallback = np.array([model.is_byte(i) and model.id_to_piece(i) not in ("<0x0A>", "<0x0D>", "<0x09>") for i in range(n)])

    def measure(self, text: str) -> tuple[int, float, float, float]:
        """Tokens, characters per token, fallback share, token entropy."""
        from .tokens import SPLIT_BYTES, safe_pieces

        parts = [text]
        if self.count.splits and len(text) > SPLIT_BYTES:
            parts = [p.decode() for p in safe_pieces(text.encode())]
        seen = np.zeros(len(self.fallback), dtype=np.int64)
        for ids in self.count.encode(parts):
            own = np.bincount(np.array(ids, dtype=np.int64))
            seen[: len(own)] += own
        n = int(seen.sum())
        if not n:
            return 0, 0.0, 0.0, 0.0
        c = seen[seen > 0]
        return n, len(text) / n, float(seen[self.fallback].sum()) / n, float(np.log2(n) - (c * np.log2(c)).sum() / n)


def verdict(n: int, chars: float, fallback: float, entropy: float, band: Band) -> bool:
    if not n:
        return False
    ok = band.chars_per_token[0] <= chars <= band.chars_per_token[1] and fallback <= band.most_fallback
    return ok and (n < band.least_tokens or band.entropy[0] <= entropy <= band.entropy[1])


def apply_rules(
    df: DataFrame,
    model_path: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    lang_col: str | None = None,
    bands: dict[str, Band] | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_tokens, chars_per_token,
    fallback_share, token_entropy, script.

    ``bands`` may hold languages (values of ``lang_col``) beside scripts.  A
    null text has no words and isn't kept; a null id is handed on; repeated
    rows give repeated results.
    """
    use = BANDS | (bands or {})
    carry = [id_col, lang_col] if lang_col else [id_col]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3 + [pa.string()]
    ddl = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
        "n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, script string"
    )
    by_lang = {k: b for k, b in (bands or {}).items()}

    def rules(texts: list[bytes | None], fertility: Fertility) -> list[pa.Array]:
        words: list[bytes] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                own = t.split()
                counts[i] = len(own)
                words += own
        repeats = repeated_window_words(words, counts)
        rows = []
        for i, t in enumerate(texts):
            t = t or b""
            text = t.decode("utf-8", "replace")
            n_words = int(counts[i])
            chars = len(text) - (len(t) - len(t.translate(None, _SPACES)))
            lines = [x for x in t.split(b"\n") if x.strip(_SPACES)]
            failed = n_words < 50 or 100 * int(repeats[i]) > 50 * n_words
            script = script_of(text)
            n, per, fallback, entropy = fertility.measure(text) if n_words else (0, 0.0, 0.0, 0.0)
            kept = not failed and verdict(n, per, fallback, entropy, use[script])
            rows.append((n_words, chars, len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), int(repeats[i]), failed, kept, n, per, fallback, entropy, script))
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]

    got = map_texts(df, text_col, carry, ddl, rules, lambda: Fertility(model_path))
    if not lang_col:
        return got
    from pyspark.sql import functions as F

    inside = F.col("kept")
    for lang, b in by_lang.items():
        ok = F.col("chars_per_token").between(*b.chars_per_token) & (F.col("fallback_share") <= b.most_fallback) & ((F.col("n_tokens") < b.least_tokens) | F.col("token_entropy").between(*b.entropy))
        inside = F.when(F.col(f"`{lang_col}`") == lang, ~F.col("base_failed") & (F.col("n_tokens") > 0) & ok).otherwise(inside)
    return got.withColumn("kept", inside)
