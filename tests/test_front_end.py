import pickle
import warnings

import pytest

from sylvan.errors import LexError, ParseError, ValidationError
from sylvan.plans import ast
from sylvan.plans.analysis import flatten, resolve, validate
from sylvan.plans.dialect import PatternError, nests_repeats, to_java, to_python
from sylvan.plans.grammar import Grammar, parse_to_json
from sylvan.plans.lexer import tokenize
from sylvan.plans.parser import parse


def kinds(text):
    return [t.kind for t in tokenize(text)]


def test_tokens():
    assert kinds("define nl /\\n/  # why\n") == ["define", "name", "regex", "newline", "end"]
    assert kinds("grammar a(b):\n    match 'x' 12 $1 $n | 2nd:") == ["grammar", "name", "(", "name", ")", ":", "newline", "indent", "match", "string", "number", "capture", "capture", "|", "name", ":", "end"]
    assert kinds("skipline matches") == ["name", "name", "end"]
    assert kinds("! all of this") == ["end"]
    assert kinds("\t\tx\n  y") == ["indent", "name", "newline", "name", "end"]
    assert [t.text for t in tokenize(r"'a\'b' /a\/b/")][:2] == [r"'a\'b'", r"/a\/b/"]


@pytest.mark.parametrize(("text", "line", "col", "offset"), [("ok\n  ;", 2, 3, 5), ("'é' 'open", 1, 5, 5), ("a\rb", 1, 2, 1)])
def test_lex_errors_have_places(text, line, col, offset):
    with pytest.raises(LexError) as e:
        tokenize(text)
    assert (e.value.span.line, e.value.span.col, e.value.span.offset) == (line, col, offset)


def test_statements():
    s = parse(
        """
define a /x/
grammar base:
    skip /\\s+/
grammar input(base):
    match a
        'b' | 3:
        out.create('p', '$0')
        sub
    imatch 'Q': do.next()
    when $1 $name:
        do.return(2, "t")
    tail()
"""
    )
    assert s.defines == {"a": ast.Pattern("x")}
    first, second, third, fourth = s.grammars["input"].statements
    assert first.alternatives == ((ast.Name("a"), ast.Text("b")), (ast.Number(3),))
    assert [c.name for c in first.actions] == ["out.create", "sub"]
    assert second.ignore_case and second.consumes
    assert not third.consumes and third.alternatives == ((ast.Group(1), ast.NamedGroup("name")),)
    assert third.actions == (ast.Call("do.return", (ast.Number(2), ast.Text("t"))),)
    assert fourth == ast.Call("tail")
    assert len(flatten(s, "input")) == 5


def test_a_block_ends_where_its_indent_gets_smaller():
    s = parse("grammar input:\n    match 'a':\n        out.add('x')\n        out.add('y')\n    out.add('z')\n")
    match, call = s.grammars["input"].statements
    assert len(match.actions) == 2 and call.name == "out.add"


def test_the_last_definition_counts():
    s = parse("define a 'x'\ndefine a 'y'\ngrammar g:\n    a()\ngrammar g:\n    b()\n")
    assert s.defines["a"] == ast.Text("y") and s.grammars["g"].statements == (ast.Call("b"),)


@pytest.mark.parametrize("text", ["grammar g:\n    match 'a':\n", "define x\n", "grammar g\n", "x", "grammar g:\n    match 'a' ):\n        b()\n", "define n 99999999999999999999\n"])
def test_parse_errors(text):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.span is not None


def test_names_resolve_through_chains_and_circles_stay():
    defines = {"a": ast.Name("b"), "b": ast.Text("x"), "c": ast.Name("d"), "d": ast.Name("c")}
    assert resolve(ast.Name("a"), defines) == ast.Text("x")
    assert resolve(ast.Name("c"), defines) == ast.Name("c")
    assert resolve(ast.Name("z"), defines) == ast.Name("z")


def test_validation():
    found = validate(parse("grammar g(nobody):\n    match v /(/:\n        other()\n"))
    assert [d.severity for d in found] == ["warning", "warning", "error", "error"]
    assert "undefined grammar reference 'other' in grammar 'g'" in found[0].message
    assert "undefined variable 'v' in grammar 'g'" in found[1].message
    assert found[3].message == "grammar 'g' inherits from undefined grammar 'nobody'"
    with pytest.raises(ValidationError):
        Grammar.compile("grammar g(nobody):\n    x()\n")
    with pytest.raises(ValueError, match="at least 1"):
        Grammar.compile("grammar g:\n    x()\n", search_window=0)


def test_inheritance_circles_end():
    assert len(flatten(parse("grammar a(b):\n    x()\ngrammar b(a):\n    y()\n"), "a")) == 2


def test_grammars_can_be_pickled():
    g = Grammar.compile("grammar input:\n    match /a/:\n        out.add('x', '$0')\n", preserve_case=True, search_window=7)
    again = pickle.loads(pickle.dumps(g))
    assert again == g and again.source == g.source


def test_json_of_a_program():
    text = parse_to_json("define a /x/\ngrammar input:\n    skip a\n    match $1 $n 4:\n        f('s')\n")
    assert '"type": "regex",\n      "value": "x"' in text and '"index": 1' in text and '"name": "n"' in text and '"flags": 0' in text


@pytest.mark.parametrize(
    ("pattern", "text", "end"),
    [
        ("a(?i)b|c", "C", 1),
        ("a(?i)b|c", "aB", 2),
        ("a(?i)b|c", "Ab", None),
        (r"\s", "\x1c", None),
        (r"\s+", " \x0b\x85\u3000x", 4),
        (r"\S", "\x1c", 1),
        (r"x$", "x\n", None),
        (r"(?m)x$", "x\n", 1),
        (r"(?<a>x)\x{e9}", "xé", 2),
        (r"\u00e9", "é", 1),
        ("[[:digit:]-]+", "1-2a", 3),
        (".+", "a\rb\n", 3),
        ("a{2,3}?b", "aab", 3),
        (r"\pL+", "aé中1", 3),
        (r"\p{Lu}\P{Lu}+", "Éaé1Z", 4),
        (r"\p{Greek}+", "αβγa", 3),
        (r"\p{^Greek}+", "abα", 2),
        (r"\p{sc=Cyrillic}+\p{gc!=Lu}", "жз1", 3),
        (r"[\p{Lu}\d]+", "É1a", 2),
        (r"[^\p{L}]+", "1 é", 2),
        ("[a-z&&[^b]]+", "acb", 2),
        ("[a-z--[bc]]+", "adeb", 3),
        ("[a-c~~b-d]+", "ad", 2),
        ("[a-c~~b-d]+", "b", None),
        ("[a[b-c]]+", "abcd", 3),
        ("[a&&b]", "a", None),
        ("[[:^alpha:]]+", "1-a", 2),
        (r"[\w&&[^\d_]]+", "é1", 1),
        (r"[\W\d]+", "1 x", 2),
        (r"[^\S\n]+", " \t\n", 2),
        ("(?i)[a-z&&[^b]]", "B", None),
        ("(?i)[a-z&&[^b]]", "C", 1),
        ("(?i)[^k]", "K", None),
        (r"(?i)[\x{212a}]", "k", 1),
        (r"(?x)[a b]+", "ab ", 2),
        (r"\w+", "नमस्ते x", 6),
        (r"\w+", "x²", 1),
        (r"\w+", "a\u200db", 3),
        (r"\W", "\u0301", None),
        (r"(?:\b.)+", "नम", 1),
        (r".\B.", "नम", 2),
        (r"a\b.", "a\u0301", None),
        (r"\<a\>", "a", 1),
        (r"a\b{end} \b{start}b", "a b", 3),
        (r"[]a]+", "]a", 2),
        (r"[^]]+", "a]", 1),
        (r"[a\-c-]+", "-ac", 3),
        (r"[$^]", "$", 1),
        (r"[\d[:alpha:]_]+\x{1F642}", "a1_🙂", 4),
    ],
)
def test_patterns(pattern, text, end):
    """Both forms for Python, the short one where the text is of ASCII alone; and Java has the same sets."""
    import re

    for ascii_only in (False, True) if text.isascii() else (False,):
        m = re.compile(to_python(pattern, ascii_only)[0]).match(text)
        assert (m and m.end()) == end
    assert to_java(pattern)


def test_the_short_form_is_equal_on_ascii():
    import random
    import re

    rng = random.Random(1)
    items = ["a", "b-f", r"\d", r"\w", r"\s", r"\W", r"\S", r"\p{Lu}", r"\P{L}", "[:punct:]", "[:^digit:]", "[x-z]", "[^m]", "_", r"\n"]
    text = "".join(map(chr, range(128)))
    for _ in range(300):
        body = "".join(rng.choice(items) for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.5:
            body += rng.choice(["&&", "--", "~~"]) + rng.choice(items)
        pattern = rng.choice(["", "(?i)"]) + "[" + rng.choice(["", "^"]) + re.sub(r"\[:", "[[:", body).replace(":]", ":]]") + "]"
        whole, short = (re.findall(to_python(pattern, x)[0], text) for x in (False, True))
        assert whole == short, pattern


def test_sets_of_code_points():
    from sylvan.plans import charsets

    assert charsets.complement(charsets.complement(charsets.SPACE)) == charsets.SPACE
    assert charsets.union(charsets.perl("w"), charsets.perl("W")) == charsets.EVERY
    for c in "aZ9_é中²½\u0301\u200d ":
        import regex

        inside = any(lo <= ord(c) <= hi for lo, hi in charsets.perl("w"))
        assert inside == bool(regex.fullmatch(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]", c)), c
    with pytest.raises(ValueError, match="no such property"):
        charsets.prop("Nonsense")


@pytest.mark.parametrize(("pattern", "nested"), [("(a+)+b", True), ("(?:a*)*", True), ("((a|b+))*", True), ("(a+b)+", False), ("a+b*", False), ("(a{2})+", False)])
def test_nested_repeats_are_told(pattern, nested):
    assert nests_repeats(pattern) == nested
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        Grammar.compile(f"grammar input:\n    match /{pattern}/:\n        out.add('x')\n")
    assert bool(told) == nested


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)", r"(a)\1", "a++", "a*+", r"\q", "(", "[", "a)", "*a", r"\p{Nonsense}", r"\p{", "[z-a]", r"[a-\d]", "[[:nonsense:]]", "[a", r"\x{110000}"])
def test_patterns_that_the_dialect_lacks(pattern):
    with pytest.raises(PatternError):
        to_python(pattern)


def test_java_patterns():
    assert to_java(r"(?P<n>\w+)\x{e9}$") == r"(?<n>\w+)é\z"
