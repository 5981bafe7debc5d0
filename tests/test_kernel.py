import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sylvan.catalogue_language import SKIP_KINDS
from sylvan.functions.writers import write_tree
from sylvan.operators import kernel
from sylvan.plans.grammar import Grammar


def run(body, text, record=False, preserve_case=False, window=None, start="input"):
    return Grammar.compile(body, preserve_case=preserve_case, search_window=window).machine().run(text, start, record)


def tree(body, text, **options):
    r = run(body, text, **options)
    assert r.error is None, r.error
    return json.loads(write_tree(r.tree.root, "json"))


def test_create_add_replace():
    body = "grammar input:\n    match /\\w/:\n        out.create('c', '$0')\n        out.add('a', '$0')\n        out.replace('r', '$0')\n"
    assert tree(body, "xy") == {"c": [{"#text": "x"}, {"#text": "y"}], "a": {"#text": "xy"}, "r": {"#text": "y"}}


def test_replace_without_text_clears():
    assert tree("grammar input:\n    match 'x':\n        out.add('r', 'a')\n        out.replace('r')\n", "x") == {"r": {}}


def test_attributes_keep_their_place_and_take_the_last_value():
    body = "grammar input:\n    match /\\w/:\n        out.add_attribute('n', 'k', '$0')\n        out.add_attribute('n', 'l', 'z')\n"
    r = run(body, "xy")
    assert r.tree.root.children[0].all_attrs() == [("k", "y"), ("l", "z")]


def test_added_attributes_are_no_identity():
    body = "grammar input:\n    match 'x':\n        out.add('n?a=\"1\"')\n        out.add_attribute('n?a=\"1\"', 'b', '2')\n        out.add('n?a=\"1\"', 't')\n"
    assert tree(body, "x") == {"n": {"@a": "1", "@b": "2", "#text": "t"}}


def test_open_enter_leave():
    body = "grammar input:\n    match /\\w/:\n        out.{}('n')\n        out.add('c', '$0')\n"
    assert tree(body.format("open"), "xy") == {"n": [{"c": {"#text": "x"}}, {"c": {"#text": "y"}}]}
    assert tree(body.format("enter"), "xy") == {"n": {"c": {"#text": "xy"}}}
    assert tree("grammar input:\n    match 'x':\n        out.open('a')\n        out.leave()\n        out.leave()\n        out.add('b')\n", "x") == {"a": {}, "b": {}}


def test_open_is_left_right_after_a_call():
    body = "grammar sub:\n    match 'q':\n        out.add('s')\ngrammar input:\n    match 'x':\n        out.open('a')\n        sub()\n        out.add('b')\n"
    assert tree(body, "x") == {"a": {}, "b": {}}
    assert tree(body, "xq") == {"a": {"s": {}}}


def test_captures_count_groups_of_all_fields():
    body = "grammar input:\n    match /(a)(z)?/ /b/:\n        out.create('n', '$0-$1-$2-$3')\n"
    assert tree(body, "ab") == {"n": {"#text": "a-a--b"}}


def test_fields_backtrack_into_each_other():
    assert tree("grammar input:\n    match /a*/ 'ab':\n        out.create('n', '$0')\n", "aaab") == {"n": {"#text": "aa"}}


def test_back_references():
    body = "grammar input:\n    match /\\w/ '-' $0:\n        out.create('same', '$0')\n    match /./:\n        out.create('o')\n"
    assert tree(body, "a-a") == {"same": {"#text": "a"}}
    assert tree("grammar input:\n    match /(?P<n>\\w)+/ '-' $n:\n        out.create('same', '$n')\n", "ab-b") == {"same": {"#text": "b"}}
    assert tree("grammar input:\n    imatch /\\w/ $0:\n        out.create('same', '$0')\n", "aA") == {"same": {"#text": "a"}}
    assert tree("grammar input:\n    match /(?P<n>\\w)/:\n        out.create('x', '<$n>')\n", "a") == {"x": {"#text": "<>"}}, "names don't survive fusion"


def test_unresolved_names_match_nothing():
    r = run("grammar input:\n    match nobody:\n        out.create('x')\n", "a")
    assert r.error.startswith("grammar 'input' stopped at line 1")


def test_alternatives_and_case():
    body = "grammar input:\n    imatch 'ab' | 'Ä':\n        out.create('n', '$0')\n"
    assert tree(body, "aBÄ") == {"n": [{"#text": "aB"}, {"#text": "Ä"}]}
    assert run(body, "ä").error, "a literal in front ignores the case of ASCII letters only"
    assert tree("grammar input:\n    imatch /Ä/ 'ö':\n        out.create('n', '$0$1')\n", "äÖ") == {"n": {"#text": "äÖ"}}


def test_when_consumes_nothing():
    body = "grammar sub:\n    match /\\w/:\n        out.create('s', '$0')\n        do.return()\ngrammar input:\n    when 'x':\n        sub()\n    match /./:\n        out.create('o', '$0')\n"
    assert tree(body, "axb") == {"o": [{"#text": "a"}, {"#text": "b"}], "s": {"#text": "x"}}


def test_when_without_progress_ends():
    assert run("grammar input:\n    when 'x':\n        out.create('n')\n", "x").error.startswith("grammar 'input' stopped at line 1")


def test_consumed_counts_matches_and_skips():
    body = "grammar sub:\n    match /\\w/:\n        do.return()\ngrammar input:\n    when 'x':\n        sub()\n    skip /é/\n    match 'm':\n        sub()\n    match 'f' /./:\n        do.next()\n"
    assert run(body, "xéma").consumed == 4 and run(body, "fz").consumed == 2
    assert run("grammar input:\n    do.fail('no')\n", "abc").consumed == 0


def test_a_define_that_is_a_capture_has_no_value():
    assert tree("define c $0\ngrammar input:\n    match 'x':\n        out.create('n', c)\n", "x") == {"n": {}}


def test_skip():
    assert tree("grammar input:\n    skip ' '\n    skip 7\n    skip /#.*/\n    match /\\w/:\n        out.create('n', '$0')\n", " 7a# z") == {"n": {"#text": "a"}}


def test_window():
    body = "grammar input:\n    match /a+/:\n        out.create('n', '$0')\n"
    assert [len(c.text) for c in run(body, "a" * 25, window=10).tree.root.children] == [10, 10, 5]
    assert [len(c.text) for c in run(body, "a" * 2500).tree.root.children] == [1000, 1000, 500]
    body = "grammar input:\n    match /é+/:\n        out.create('n', '$0')\n"
    assert [len(c.text) for c in run(body, "é" * 5, window=3).tree.root.children] == [2, 2, 1], "up to the next character"
    assert run("grammar input:\n    skip /[^\\n]*\\n/\n", "a" * 50 + "\n", window=10).error is None, "plain skips have no window"
    assert run("grammar input:\n    match /^a$/ /.*/:\n        out.create('n')\n", "ab", window=1).tree.root.children, "the window is the text"


def test_anchors_see_the_cursor():
    assert tree("grammar input:\n    match /^\\bx/:\n        out.create('n')\n", "xx") == {"n": [{}, {}]}


def test_empty_input_runs_once():
    assert tree("grammar input:\n    match /x*/:\n        out.create('n')\n", "") == {"n": {}}


def test_return_levels():
    body = "grammar c:\n    match 'x':\n        do.return({})\ngrammar b:\n    c()\n    match 'y':\n        out.create('b')\ngrammar input:\n    match 'y':\n        out.create('i')\n    b()\n"
    assert tree(body.format(1), "xy") == {"b": {}}
    assert tree(body.format(2), "xy") == {"i": {}}
    assert tree(body.format("'2'"), "xy") == {"i": {}}
    assert tree(body.format(0), "xy") == {"b": {}}
    assert run(body.format(3), "xy").error.startswith("grammar 'input' stopped")


def test_next_skip_say_warn_fail():
    body = "grammar input:\n    match 'x':\n        do.say('$0')\n        do.warn('w')\n        do.{}\n        out.create('n')\n    match /./:\n        out.create('o')\n"
    r = run(body.format("next()"), "xy", record=True)
    assert r.traces == ["say: x", "warn: w", "match consumed 1 chars"] and len(r.tree.root.children) == 1
    r = run(body.format("skip()"), "x", record=True)
    assert r.traces[-1] == "match consumed 1 chars"
    r = run(body.format("fail('no $0')"), "xy")
    assert (r.error, r.consumed) == ("no x", 2) and r.traces[-2:] == ["fail invoked", "fail: no x"]
    assert run(body.format("fail()"), "xy").error == "fail"
    assert run("grammar s:\n    match 'x':\n        do.fail('deep')\ngrammar input:\n    s()\n", "xy").error == "deep"


def test_depth():
    assert run("grammar input:\n    input()\n", "x\n").error == "grammar calls nested more than 250 levels deep (calling 'input' at line 1)"


def test_unconsumed_input():
    r = run("grammar input:\n    match /a\\n/:\n        out.create('n')\n", 'a\nb"\\\'\u0001é' + "z" * 50)
    assert r.error == "grammar 'input' stopped at line 2 before the end of the input: \"b\\\"\\\\'\\u{1}é" + "z" * 34 + '"'


def test_trigger_order_and_survivors():
    body = """
grammar input:
    match 'q':
        out.enqueue_after(/1/, 'a', '1')
        out.enqueue_after(/2/, 'a', '2')
        out.enqueue_after(/[13]/, 'a', '3')
        out.enqueue_after(/[14]/, 'a', '4')
    match /\\d/:
        do.skip()
"""
    assert tree(body, "q1") == {"a": {"#text": "431"}}
    assert tree(body, "q21") == {"a": {"#text": "2341"}}, "the last entry took the place of the one that fired"


def test_triggers_see_raw_captures():
    assert tree("grammar input:\n    match /\\S+/ ' ':\n        out.enqueue_before(/./, 'a', '\\$0')\n    match /\\S+/:\n        do.skip()\n", "x a/b") == {"a": {"#text": "a/b"}}


def test_clear_queue_keeps_leave_and_lasting():
    body = "grammar input:\n    match 'q':\n        out.enqueue_after(/./, 'n')\n        out.enqueue_on_leave(/./, 'l')\n        out.enqueue_after_persist(/./, 'p')\n        out.clear_queue()\n        out.open('o')\n"
    assert tree(body, "q") == {"o": {"l": {}}, "p": {}}


def test_unknown_actions_do_nothing_but_are_logged():
    r = run("grammar input:\n    match 'x':\n        my.own('a')\n        out.enqueue_after('no', 'n')\n", "x", record=True)
    assert [a[0] for a in r.actions] == ["my.own", "out.enqueue_after"] and not r.tree.root.children


def test_paths():
    body = "grammar input:\n    match 'x':\n        out.create({})\n"
    assert tree(body.format("'A b/C?K=\"v/w\"&L=u&K=\"2\"', 't'"), "x") == {"a-b": {"c": {"@k": "v/w", "@l": "u", "#text": "t"}}}
    assert tree(body.format("'A b'"), "x", preserve_case=True) == {"A-b": {}}
    assert tree(body.format("'a%2Fb', '%41%zz'"), "x") == {"a/b": {"#text": "A%zz"}}
    assert tree(body.format("'.', 't'"), "x") == {"#text": "t"}
    assert tree(body.format("'', 't'"), "x") == {}
    assert tree(body.format("'./a/.', 't'"), "x") == {"a": {"#text": "t"}}


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30))
def test_captured_text_comes_back(s):
    got = run("grammar input:\n    match /(?s).*/:\n        out.create('n', '<$0>')\n        out.create('m?k=\"$0\"')\n", s, window=10_000).tree.root
    assert got.children[0].text == f"<{s}>"
    assert got.children[1].attrs == (("k", s),)


@given(st.text(alphabet="ab \n#é", max_size=40), st.integers(1, 12))
def test_any_input_ends(s, window):
    body = "grammar s:\n    skip /#[^\\n]*/\n    match /a+/ /b?/:\n        out.add('n', '$0')\n    when 'b':\n        do.return(2)\ngrammar input:\n    s()\n    match /[ b]/:\n        out.open('o')\n        s()\n    skip /\\n/\n"
    r = run(body, s, window=window, record=True)
    assert r.error is None or "é" in s or "stopped" in r.error
    assert r.consumed <= len(s.encode())


@pytest.mark.parametrize("text", ["", "x", "x\ny\n"])
def test_lines(text):
    r = run("define nl /\\n/\ngrammar input:\n    match /[^\\n]*/ nl | /[^\\n]+/:\n        out.create('line', '$0')\n", text)
    assert [c.text for c in r.tree.root.children] == [x for x in text.split("\n")][: -1 if text.endswith("\n") or not text else None]


@given(st.lists(st.sampled_from(["ab", "abc", "abcd", "  x", "  xy", "  y", " ", "a", "é", "\n"]), max_size=12))
def test_rules_are_chosen_by_what_stands_at_the_cursor(parts):
    """The first rule that matches wins, however much of the literals is looked at to choose it."""
    literals = ["abcd", "abc", "  xy", "  x", "  y", "ab", "a", " "]
    body = "grammar input:\n" + "".join(f"    match '{x}':\n        out.add('all', '{i}')\n" for i, x in enumerate(literals)) + "    match /[^a ]/:\n        out.add('all', '.')\n"
    text, at, want = "".join(parts), 0, ""
    while at < len(text):
        i = next((i for i, x in enumerate(literals) if text.startswith(x, at)), None)
        want += "." if i is None else str(i)
        at += 1 if i is None else len(literals[i])
    assert tree(body, text) == ({"all": {"#text": want}} if want else {})


def test_many_texts_at_the_cursor(monkeypatch):
    from sylvan.operators import kernel

    monkeypatch.setattr(kernel, "_PICKED", 3)
    body = "grammar input:\n    match 'key' /\\d+/ /\\n/:\n        out.create('k', '$1')\n    match /[^\\n]*/ /\\n/:\n        out.create('o', '$0')\n"
    text = "".join(f"key{i}\nke{i}\n{i}\n" for i in range(50))
    got = tree(body, text)
    assert [x["#text"] for x in got["k"]] == [str(i) for i in range(50)] and len(got["o"]) == 100


@pytest.mark.parametrize("text", ["bcd aé fgh\nxyz", "bcd ae fgh\nxyz"])
def test_texts_within_the_window_take_the_short_way(text, monkeypatch):
    """No end of the window is looked for, and templates of one capture read it at once."""

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(kernel.Run, "capture", never)
    monkeypatch.setattr(kernel.Run, "reach", never)
    g = Grammar.compile("grammar input:\n    match /[\\p{L}&&[^aeiou]]+/:\n        out.add('all', '$0,')\n    skip /(?s:.)/\n", search_window=1 << 20)
    got = g.machine().run(text)
    assert got.error is None and got.consumed == len(text.encode())
    assert got.tree.root.children[0].text == ("bcd,é,fgh,xyz," if "é" in text else "bcd,fgh,xyz,")


@pytest.mark.parametrize("kind", range(len(SKIP_KINDS)))
def test_first_skip_repeats_as_if_alone(kind):
    text = "# a \n\n!b\r\n\r\nword 12\t .\n  \n\nlast \r\n" * 5
    pattern = SKIP_KINDS[kind][1]
    body = "    match /(?s:.{1,4})/:\n        out.add('rest', '$0')\n"
    first = Grammar.compile(f"grammar input:\n    skip /{pattern}/\n{body}", search_window=1 << 20).machine()
    second = Grammar.compile(f"grammar input:\n    match 'never':\n        do.skip()\n    skip /{pattern}/\n{body}", search_window=1 << 20).machine()
    one, two = first.run(text), second.run(text)
    assert (one.consumed, one.error, [(n.name, n.text) for n in one.tree.root.children]) == (two.consumed, two.error, [(n.name, n.text) for n in two.tree.root.children])
