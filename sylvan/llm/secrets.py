"""Secret scans (operator 5).

Base rules find assignments, access keys and hexadecimal strings.  The method
adds spans of high entropy: over each candidate string (a run of one character
class) a window slides, its Shannon entropy kept up to date by incremental
counts; windows above the class's threshold are merged into spans, unless an
allow-list entry suppresses them.  A run shorter than the window, of
``LEAST`` characters or more, is one window with a threshold scaled to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts

# The patterns of the base rules, and the order of kinds.
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "hex_entropy", "base64_entropy", "lower_entropy", "upper_entropy", "letters_entropy")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class EntropyRule:
    """A character class, its window and the entropy (bits per character) from
    which a window counts as random.  A span must hold a character of each of
    ``needs``."""

    kind: str
    chars: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()


ENTROPY_RULES = (
    EntropyRule("hex_entropy", "0-9a-fA-F", 24, 3.0),
    EntropyRule("base64_entropy", r"A-Za-z0-9+/_=\-", 24, 3.9, ("[0-9]", "[A-Z]", "[a-z]")),
    EntropyRule("lower_entropy", "a-z0-9", 24, 3.7, ("[0-9]", "[a-z]")),
    EntropyRule("upper_entropy", "A-Z0-9", 24, 3.7, ("[0-9]", "[A-Z]")),
    EntropyRule("letters_entropy", "A-Za-z", 24, 4.1, ("[A-Z]", "[a-z]")),
)
#: The shortest run that is a candidate.
LEAST = 16

#: What is no secret: paths and identifiers in words, numbers, placeholders.
#: Patterns that describe a string from end to end suppress a whole run or span;
#: of the others, only the windows that touch what they find, and the letters
#: and digits joined to it, are suppressed: a key beside such a word is found.
ALLOW = (
    r"(?i)example|placeholder|changeme|xxxx",
    r"^(?:[A-Za-z]+[-_/=+]+)+[A-Za-z]*$",
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?:0123456789|abcdefghij)",
)


def window_entropies(s: str, w: int) -> list[float]:
    """The Shannon entropy of every window of ``w`` characters (of all of ``s``
    where it is shorter).  With S the sum of c*log2(c) over the counts, the
    entropy is log2(w) - S/w; a step changes two counts."""
    n = min(w, len(s))
    if not n:
        return []
    part = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    out = []
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += part[k + 1] - part[k] if k < n else 0.0
        counts[c] = k + 1
        if i >= n:
            d = s[i - n]
            k = counts[d]
            total += part[k - 1] - (part[k] if k <= n else part[n])
            counts[d] = k - 1
        if i >= n - 1:
            out.append(math.log2(n) - total / n)
    return out


def entropy_spans(s: str, rule: EntropyRule, allowed: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Merged spans of ``s`` whose windows reach the rule's threshold, which is
    less for a shorter string, as its entropy can reach less.  Windows that
    touch an allowed place don't count."""
    spans: list[list[int]] = []
    window = min(rule.window, len(s))
    least = rule.bits * math.log2(window) / math.log2(rule.window) if window else 0.0
    for i, bits in enumerate(window_entropies(s, window)):
        if bits >= least and not any(a < i + window and i < b for a, b in allowed):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + window
            else:
                spans.append([i, i + window])
    return [(a, b) for a, b in spans]


def base_spans(text: str, lowered: str | None = None) -> list[tuple[str, int, int]]:
    """Spans of the base rules, leftmost and non-overlapping within a kind."""
    out = []
    lowered = text.lower() if lowered is None else lowered
    if any(w in lowered for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Scanner:
    def __init__(self, rules=ENTROPY_RULES, allow=ALLOW):
        self.rules = [(r, re.compile(rf"(?<![{r.chars}])[{r.chars}]{{{min(LEAST, r.window)},}}")) for r in rules]
        self.needs = {r.kind: [re.compile(p) for p in r.needs] for r in rules}
        self.whole = [re.compile(p) for p in allow if p.startswith("^") and p.endswith("$")]
        self.places = [re.compile(p) for p in allow if not (p.startswith("^") and p.endswith("$"))]
        self.word = re.compile("[A-Za-z0-9]*")
        self.joins = re.compile("[A-Za-z0-9]").match
        least = min((min(LEAST, r.window) for r in rules), default=32)
        every = "".join(r.chars for r in rules) + "0-9a-f"
        #: Runs that any rule but assign and access can match in.
        self.runs = re.compile(rf"[{every}]{{{min(least, 32)},}}")

    def allowed(self, text: str) -> list[tuple[int, int]]:
        """The allowed places of a text, with the letters and digits joined to them."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(m.span() for p in self.places for m in p.finditer(text)):
            if out and b <= out[-1][1]:
                continue
            end = self.word.match(text, b).end()
            while a and self.joins(text[a - 1]):
                a -= 1
            out.append((a, end))
        return out

    def added(self, text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        allowed = None
        for rule, pattern in self.rules:
            for m in pattern.finditer(text):
                s, at = m[0], m.start()
                needs = self.needs[rule.kind]
                if any(a.search(s) for a in self.whole) or not all(n.search(s) for n in needs):
                    continue
                if allowed is None:
                    allowed = self.allowed(text)
                for start, end in entropy_spans(s, rule, [(a - at, b - at) for a, b in allowed if a < m.end() and at < b]):
                    found = s[start:end]
                    start, end = start + at, end + at
                    # What an earlier class has found isn't reported again.
                    if not all(n.search(found) for n in needs) or any(a.search(found) for a in self.whole) or any(a <= start and end <= e for _, a, e in out):
                        continue
                    out.append((rule.kind, start, end))
        return out

    def scan(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and added spans, each by start and then kind."""
        key = lambda x: (x[1], KINDS.index(x[0]), x[2])
        run = self.runs.search(text)
        lowered = text.lower()
        if not run and "AKIA" not in text and not any(w in lowered for w in _WORDS):
            return [], []
        return sorted(base_spans(text, lowered), key=key), sorted(self.added(text), key=key) if run else []


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex,
    base_spans, spans (all, base ones included).

    A null text is empty and has no spans; a null id is handed on; repeated
    rows give repeated results; other columns are not read.
    """

    def scan(texts: list[bytes | None], scanner: Scanner) -> list[pa.Array]:
        n = {k: [] for k in KINDS[:3]}
        base, every = [], []
        key = lambda x: (x[1], KINDS.index(x[0]), x[2])
        for t in texts:
            b, more = scanner.scan(t.decode("utf-8", "replace")) if t else ([], [])
            for k in n:
                n[k].append(sum(x[0] == k for x in b))
            base.append(joined(b))
            every.append(joined(sorted(b + more, key=key)))
        return [*(pa.array(x, pa.int64()) for x in n.values()), pa.array(base, pa.string()), pa.array(every, pa.string())]

    return map_texts(df, text_col, [id_col], "n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string", scan, Scanner)


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mask``; overlapping
    spans become one.  All rows and columns stay, null texts stay null."""
    rest = [c for c in df.columns if c != text_col]
    name = fresh(df, "clean_text")

    def redact(texts: list[bytes | None], scanner: Scanner) -> list[pa.Array]:
        out = []
        for t in texts:
            if t:
                s = t.decode("utf-8", "replace")
                b, more = scanner.scan(s)
                if b or more:
                    parts, at = [], 0
                    for _, a, e in sorted(b + more, key=lambda x: x[1]):
                        if a >= at:
                            parts += [s[at:a], mask]
                        at = max(at, e)
                    t = "".join([*parts, s[at:]]).encode()
            out.append(t)
        return [pa.array(out, pa.binary())]

    got = map_texts(df, text_col, rest, f"`{name}` binary", redact, Scanner)
    return got.select(*[F.col(f"`{name}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
