"""String functions of the engine: in Python for the kernel, and as Spark
columns where the built-in functions can express them."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

_SAFE = re.compile(r"[A-Za-z0-9\-_.~ ]*\Z").match
_ENCODED = re.compile(rb"%([0-9A-Fa-f]{2})")


def percent_encode(s: str) -> str:
    """All bytes but letters, digits, ``-_.~`` and space as ``%XX``."""
    return s if _SAFE(s) else quote(s, safe=" ")


def percent_decode(s: str) -> str:
    """Decode ``%XX``; a text that isn't UTF-8 then stays as it was."""
    if "%" not in s:
        return s
    try:
        return _ENCODED.sub(lambda m: bytes.fromhex(m[1].decode()), s.encode()).decode()
    except UnicodeDecodeError:
        return s


def normalize_name(name: str, preserve_case: bool = False) -> str:
    """Spaces become ``-``; lower case, unless the case is preserved."""
    name = name.replace(" ", "-")
    return name if preserve_case else name.lower()


def debug_string(s: str) -> str:
    """In double quotes, with escapes for what can't be printed."""
    marks = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", '"': '\\"', "\\": "\\\\"}
    return '"' + "".join(marks.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in s) + '"'


def line_number(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


# --- as Spark columns ---


def percent_encoded(col: Column) -> Column:
    """:func:`percent_encode` of a string column, with built-in functions."""
    out = F.url_encode(col)
    for was, now in (("+", " "), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def percent_decoded(col: Column) -> Column:
    """:func:`percent_decode` of a string column.  Text that holds a ``%``
    which begins no code, or no UTF-8, is handed on as it is."""
    plain = F.replace(F.replace(col, F.lit("+"), F.lit("%2B")), F.lit("%%"), F.lit("%25%"))
    return F.coalesce(F.try_url_decode(plain), col)


def normalized_name(col: Column, preserve_case: bool = False) -> Column:
    out = F.replace(col, F.lit(" "), F.lit("-"))
    return out if preserve_case else F.lower(out)


def line_of(text: Column, at: Column) -> Column:
    """The line number of a character position from 0 on."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), at), "[^\n]", "")) + 1
