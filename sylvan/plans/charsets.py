"""Sets of code points: what the classes of a pattern stand for.

A set is a tuple of sorted, disjoint, inclusive ranges.  Properties come from
the tables of the ``regex`` module, general categories from ``unicodedata``
where that module isn't installed.
"""

from __future__ import annotations

import functools
import re
import unicodedata

try:
    import regex
except ImportError:  # only categories then
    regex = None

Ranges = tuple[tuple[int, int], ...]

LAST = 0x10FFFF
EVERY: Ranges = ((0, LAST),)
ASCII: Ranges = ((0, 0x7F),)


def union(*sets: Ranges) -> Ranges:
    out: list[list[int]] = []
    for lo, hi in sorted(r for s in sets for r in s):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def complement(s: Ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in s:
        if at < lo:
            out.append((at, lo - 1))
        at = hi + 1
    return (*out, (at, LAST)) if at <= LAST else tuple(out)


def intersection(a: Ranges, b: Ranges) -> Ranges:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def difference(a: Ranges, b: Ranges) -> Ranges:
    return intersection(a, complement(b))


def symmetric_difference(a: Ranges, b: Ranges) -> Ranges:
    return difference(union(a, b), intersection(a, b))


@functools.cache
def _cased() -> tuple[dict[int, list[int]], list[int]]:
    """For each letter with a case, all that differ from it by case only."""
    by_fold: dict[str, list[int]] = {}
    for cp in range(LAST + 1):
        c = chr(cp)
        if c.lower() != c or c.upper() != c:
            fold = c.casefold()
            by_fold.setdefault(fold if len(fold) == 1 else c.lower(), []).append(cp)
    same = {cp: group for group in by_fold.values() if len(group) > 1 for cp in group}
    return same, sorted(same)


def folded(s: Ranges, ascii_only: bool = False) -> Ranges:
    """With all that differ by case only from what is in the set."""
    if ascii_only:
        pairs = [(lo, lo ^ 0x20) for lo in (*range(0x41, 0x5B), *range(0x61, 0x7B))] + [(0x17F, 0x53), (0x17F, 0x73), (0x212A, 0x4B), (0x212A, 0x6B)]
        return union(s, tuple((b, b) for a, b in pairs if intersection(s, ((a, a),))))
    from bisect import bisect_left, bisect_right

    same, order = _cased()
    more = {x for lo, hi in s for cp in order[bisect_left(order, lo) : bisect_right(order, hi)] for x in same[cp]}
    return union(s, tuple((x, x) for x in sorted(more)))


#: The long s and the Kelvin sign, which are letters of ASCII in another case.
_ASCII_FOLDS = (0x17F, 0x212A)


@functools.cache
def _text_of(ascii_only: bool) -> str:
    return "".join(map(chr, (*range(0x80), *_ASCII_FOLDS) if ascii_only else (*range(0xD800), *range(0xE000, LAST + 1))))


@functools.cache
def _found(pattern: str, ascii_only: bool) -> Ranges:
    """The code points that a pattern of the ``regex`` module matches."""
    out = []
    text = _text_of(ascii_only)
    for m in regex.finditer(pattern[:-1] if ascii_only else pattern, text):
        start, end = ord(m[0][0]), ord(m[0][-1])
        # The text leaves the surrogates out.
        out += [(start, 0xD7FF), (0xE000, end)] if start < 0xD800 and end > 0xDFFF else [(start, end)]
    return union(tuple(out))


@functools.cache
def _categories(names: tuple[str, ...], ascii_only: bool) -> Ranges:
    """The code points of general categories, or of groups of them."""
    if regex is not None:
        return _found("[" + "".join(rf"\p{{{c}}}" for c in names) + "]+", ascii_only)
    return union(tuple((cp, cp) for cp in map(ord, _text_of(ascii_only)) if unicodedata.category(chr(cp)).startswith(names)))


def prop(name: str, ascii_only: bool = False) -> Ranges:
    """The set of a property: a category, a script, ``name=value`` and so on;
    ``^`` in front negates.  A ValueError if there is no such property.  With
    ``ascii_only`` it is right for the characters of ASCII."""
    name = name.strip()
    if name.startswith("^"):
        return complement(prop(name[1:], ascii_only))
    if "!=" in name:
        key, _, value = name.partition("!=")
        return complement(prop(f"{key}={value}", ascii_only))
    if name.lower() in ("any", "ascii", "assigned"):
        return {"any": EVERY, "ascii": ASCII}.get(name.lower()) or complement(_categories(("Cn",), ascii_only))
    key, _, value = name.replace(":", "=").rpartition("=")
    if value in _CATEGORIES and key.lower() in ("", "gc", "general_category"):
        return _categories((value,), ascii_only)
    if regex is None:
        raise ValueError(f"the property {name!r} needs the 'regex' module")
    if not re.fullmatch(r"[\w\- ]+(?:[=:][\w\- ]+)?", name):
        raise ValueError(f"no such property: {name!r}")
    try:
        return _found(rf"\p{{{name}}}+", ascii_only)
    except regex.error:
        raise ValueError(f"no such property: {name!r}") from None


# The general categories of Unicode.
_CATEGORIES = frozenset("C Cc Cf Cn Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
# The characters with the Unicode property White_Space.
SPACE: Ranges = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# Letters in circles and squares, which are alphabetic without being letters by category, and the joiners.
_MORE_WORD: Ranges = ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))




@functools.cache
def perl(letter: str, ascii_only: bool = False) -> Ranges:
    """The set of ``\\d``, ``\\s``, ``\\w`` and their complements.  Words
    have alphabetic characters, marks, decimal digits, connectors and joiners."""
    if letter.isupper():
        return complement(perl(letter.lower(), ascii_only))
    if letter == "s":
        return SPACE
    if letter == "d":
        return _categories(("Nd",), ascii_only)
    return union(_categories(("L", "Nl", "M", "Nd", "Pc"), ascii_only), _MORE_WORD)
