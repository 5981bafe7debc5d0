"""Whole programs of the shapes that such grammars are written for, with their
whole outputs: a diary of four levels in two languages, a device configuration
with most features, cells in and out of quotes, records with headings, lines."""

import io
import json

import pytest

from sylvan import api

CASES = {}


CASES['log'] = (
    r'''
define nl /\r?\n/
define ws /[ \t]+/
define rest /[^\r\n]*/
define int /\d+/
grammar leg:
    match '    ' /[A-ZÄÖÜ][\p{L}\p{M} ]*/ ': ' /[\d.,]+/ ' km' nl:
        out.create('leg?place="$1"', '$3')
    match '    ' /["'][^\r\n]*["']/ nl:
        out.add('note', '$1')
    match nl:
        do.return()
grammar day:
    match '  ' /Mo|Di|Mi|Do|Fr|Sa|So/ ws /\d\d\.\d\d\./ ws rest nl:
        out.open('day')
        out.add('Weekday Name', '$1')
        out.add('date', '$3')
        out.add('kind', '$5')
        leg()
    match '  Ruhe' ws /(?:Mo|Di|Mi|Do|Fr|Sa|So)/ nl:
        out.create('rest?day="$2"')
    match nl:
        do.return()
grammar input:
    out.set_root_name('log')
    match 'Week' ws int nl | 'Woche' ws int nl:
        out.enter('week?number="$2"')
        day()
    skip /[#%][^\r\n]*[\r\n]+/
''',
    "% a training log\nWoche 7\n  Mo 12.02. Läufe\n    Überlingen: 12,5 km\n    'kalt & naß'\n    Ulm: 3 km\n\n  Ruhe Di\n  Mi 14.02. Rad\n\n\nWeek 7\n  Do 15.02. Rad\n    Ulm: 80.2 km\n\n\nWeek 8\n  Ruhe Fr\n",
    r'''<log>
  <week number="7">
    <day>
      <weekday-name>Mo</weekday-name>
      <date>12.02.</date>
      <kind>Läufe</kind>
      <leg place="Überlingen">12,5</leg>
      <leg place="Ulm">3</leg>
      <note>'kalt &amp; naß'</note>
    </day>
    <day>
      <weekday-name>Mi</weekday-name>
      <date>14.02.</date>
      <kind>Rad</kind>
    </day>
    <day>
      <weekday-name>Do</weekday-name>
      <date>15.02.</date>
      <kind>Rad</kind>
      <leg place="Ulm">80.2</leg>
    </day>
    <rest day="Di"/>
  </week>
  <week number="8">
    <rest day="Fr"/>
  </week>
</log>
''',
    r'''{
    "week": [
        {
            "@number": "7",
            "day": [
                {
                    "weekday-name": {
                        "#text": "Mo"
                    },
                    "date": {
                        "#text": "12.02."
                    },
                    "kind": {
                        "#text": "Läufe"
                    },
                    "leg": [
                        {
                            "@place": "Überlingen",
                            "#text": "12,5"
                        },
                        {
                            "@place": "Ulm",
                            "#text": "3"
                        }
                    ],
                    "note": {
                        "#text": "'kalt & naß'"
                    }
                },
                {
                    "weekday-name": {
                        "#text": "Mi"
                    },
                    "date": {
                        "#text": "14.02."
                    },
                    "kind": {
                        "#text": "Rad"
                    }
                },
                {
                    "weekday-name": {
                        "#text": "Do"
                    },
                    "date": {
                        "#text": "15.02."
                    },
                    "kind": {
                        "#text": "Rad"
                    },
                    "leg": {
                        "@place": "Ulm",
                        "#text": "80.2"
                    }
                }
            ],
            "rest": {
                "@day": "Di"
            }
        },
        {
            "@number": "8",
            "rest": {
                "@day": "Fr"
            }
        }
    ]
}''',
)


CASES['switch'] = (
    r'''
define nl /[\r\n]/
define name /[A-Za-z][\w.\/-]*/
define value /[^\r\n]+/
define sp / +/
grammar base:
    skip /!\n/
    match '  shutdown' nl:
        out.enqueue_on_leave(/./, 'state', 'down')
    match '  no ' value nl:
        out.add('off?what="$1"')
        do.next()
grammar port(base):
    match '  description ' /"[^"\n]*"/ nl:
        out.replace('description', '$1')
    imatch '  ip address ' /\d+\.\d+\.\d+\.\d+/ '/' /\d+/ nl:
        out.open('address')
        out.add_attribute('.', 'of', '$1/$3')
        out.add('.', '$1')
    match '  vlan ' /\d+(?:,\d+)*/ nl:
        out.add('vlans', '$1;')
        do.skip()
        out.add('never')
    match 'exit' nl:
        do.return()
grammar policy:
    match '  term ' name nl:
        out.create('term', '$1')
        out.enqueue_before(/match/, 'term/before', '\$0')
    when '   ':
        clause()
    match 'exit' nl:
        out.clear_queue()
        do.return()
grammar clause:
    match '    match ' value nl:
        out.add('term/match', '$1')
    match '    give up' nl:
        do.return(2)
grammar input:
    match 'port ' name nl:
        out.open('Port?name="$1"')
        port()
    match 'policy ' name nl:
        out.enter('policy?name="$1"')
        policy()
    match 'banner ' /\^(.)/ /[^^]*/ '^' $2 nl:
        out.create('banner', '$3')
        do.say('banner $2')
    match 'host ' name nl:
        out.set_root_name('$1')
    skip nl
    match 'reload' nl:
        out.create('late/path/of', 'a\'b')
''',
    'host core-1\n\nport ge-0/0/1\n  description "up & out"\n  IP Address 10.0.0.1/24\n  vlan 1,2\n  vlan 7\n!\n  shutdown\n  no lldp\nexit\nport ge-0/0/2\n  description "a"\n  description "b"\nexit\npolicy IN\n  term one\n    match a/b\n    match c\n  term two\nexit\npolicy OUT\n  term x\n    give up\nbanner ^CHi <there>^C\nreload\npolicy IN\n  term three\nexit\n',
    r'''<core-1>
  <port name="ge-0/0/1">
    <description>"up &amp; out"</description>
    <address of="10.0.0.1/24">10.0.0.1</address>
    <vlans>1,2;7;</vlans>
    <off what="lldp"/>
  </port>
  <port name="ge-0/0/2">
    <description>"b"</description>
  </port>
  <policy name="IN">
    <term>one<before>    match </before>
      <match>a/bc</match>
    </term>
    <term>two</term>
    <term>three</term>
    <state>down</state>
  </policy>
  <policy name="OUT">
    <term>x</term>
  </policy>
  <banner>Hi &lt;there&gt;</banner>
  <late>
    <path>
      <of>a\'b</of>
    </path>
  </late>
</core-1>
''',
    r'''{
    "port": [
        {
            "@name": "ge-0/0/1",
            "description": {
                "#text": "\"up & out\""
            },
            "address": {
                "@of": "10.0.0.1/24",
                "#text": "10.0.0.1"
            },
            "vlans": {
                "#text": "1,2;7;"
            },
            "off": {
                "@what": "lldp"
            }
        },
        {
            "@name": "ge-0/0/2",
            "description": {
                "#text": "\"b\""
            }
        }
    ],
    "policy": [
        {
            "@name": "IN",
            "term": [
                {
                    "#text": "one",
                    "before": {
                        "#text": "    match "
                    },
                    "match": {
                        "#text": "a/bc"
                    }
                },
                {
                    "#text": "two"
                },
                {
                    "#text": "three"
                }
            ],
            "state": {
                "#text": "down"
            }
        },
        {
            "@name": "OUT",
            "term": {
                "#text": "x"
            }
        }
    ],
    "banner": {
        "#text": "Hi <there>"
    },
    "late": {
        "path": {
            "of": {
                "#text": "a\\'b"
            }
        }
    }
}''',
)


CASES['cells'] = (
    r'''
define nl /\r?\n/
define ws /[ \t]*/
define bare /[^,"'\r\n]*/
grammar row:
    match '"' /[^"\n]*/ '"' ws ',' ws | "'" /[^'\n]*/ "'" ws ',' ws:
        out.create('column', '$1')
    match bare ',' ws:
        out.create('column', '$0')
    match '"' /[^"\n]*/ '"' ws nl | "'" /[^'\n]*/ "'" ws nl:
        out.create('column', '$1')
        do.return()
    match bare nl:
        out.create('column', '$0')
        do.return()
grammar input:
    when /(?s:.)/:
        out.open('line')
        row()
''',
    'a, "b, c" ,d \n,\'it\',\n"x\ty",é,<&>\n',
    r'''<xml>
  <line>
    <column>a</column>
    <column>b, c</column>
    <column>d </column>
  </line>
  <line>
    <column/>
    <column>it</column>
    <column/>
  </line>
  <line>
    <column>x	y</column>
    <column>é</column>
    <column>&lt;&amp;&gt;</column>
  </line>
</xml>
''',
    r'''{
    "line": [
        {
            "column": [
                {
                    "#text": "a"
                },
                {
                    "#text": "b, c"
                },
                {
                    "#text": "d "
                }
            ]
        },
        {
            "column": [
                {},
                {
                    "#text": "it"
                },
                {}
            ]
        },
        {
            "column": [
                {
                    "#text": "x\ty"
                },
                {
                    "#text": "é"
                },
                {
                    "#text": "<&>"
                }
            ]
        }
    ]
}''',
)


CASES['contacts'] = (
    r'''
define nl /\n/
define key /[A-Z][a-z]*(?: [a-z]+)*/
define value /[^,\n]+/
define any /[^\n]*/
grammar contact:
    match key /: +/ any nl:
        out.add('$0', '$2')
    match nl:
        do.return()
grammar input:
    match 'Contact' nl /=+/ nl 'Given: ' value ', Family: ' value nl:
        out.open('contact')
        out.add_attribute('.', 'given', '$5')
        out.add_attribute('.', 'family', '$7')
        contact()
''',
    'Contact\n=======\nGiven: Ada, Family: L & B\nHome town: London: west\nDay of birth: 10 December\n\nContact\n=======\nGiven: É, Family: x\n\n',
    r'''<xml>
  <contact given="Ada" family="L %26 B">
    <home-town>London: west</home-town>
    <day-of-birth>10 December</day-of-birth>
  </contact>
  <contact given="%C3%89" family="x"/>
</xml>
''',
    r'''{
    "contact": [
        {
            "@given": "Ada",
            "@family": "L %26 B",
            "home-town": {
                "#text": "London: west"
            },
            "day-of-birth": {
                "#text": "10 December"
            }
        },
        {
            "@given": "%C3%89",
            "@family": "x"
        }
    ]
}''',
)


CASES['lines'] = (
    r'''define nl /[\r\n]/
define line /[^\r\n]*/
grammar input:
    match line nl:
        out.create('line', '$0')
''',
    'one\n\n two \r\nénd\n',
    r'''<xml>
  <line>one</line>
  <line/>
  <line> two </line>
  <line/>
  <line>énd</line>
</xml>
''',
    r'''{
    "line": [
        {
            "#text": "one"
        },
        {},
        {
            "#text": " two "
        },
        {},
        {
            "#text": "énd"
        }
    ]
}''',
)




@pytest.mark.parametrize("name", CASES)
def test_outputs_are_whole(name):
    grammar, text, xml, as_json = CASES[name]
    c = api.compile_string(grammar)
    assert c.generate_string(text, "xml") == xml
    assert c.generate_string(text, "json") == as_json
    for fmt in ("xml", "json", "yaml"):
        stream = io.StringIO()
        api.serialize_tree_to_writer(api.execute_tree(grammar, "input", text), fmt, stream)
        assert stream.getvalue() == c.generate_string(text, fmt)
    assert json.loads(api.parse_and_run(grammar, "input", text))["output"] == json.loads(as_json)


def test_outputs_are_equal_in_tables(spark):
    from sylvan.operators import parse
    from sylvan.plans.grammar import Grammar

    for grammar, text, xml, as_json in CASES.values():
        docs = spark.createDataFrame([(i, text) for i in range(3)], "k int, text string")
        for fmt, want in (("xml", xml), ("json", as_json)):
            got = parse.parse(docs, Grammar.compile(grammar), fmt=fmt).collect()
            assert [r.output for r in got] == [want] * 3 and not any(r.error for r in got)


def test_a_failed_run_writes_nothing():
    stream = io.StringIO()
    with pytest.raises(api.ParsingFailed):
        api.serialize_tree_to_writer(api.execute_tree(CASES["lines"][0], "input", "no end"), "json", stream)
    assert stream.getvalue() == "" and api.execute_and_serialize(CASES["lines"][0], "input", "a\n", "none") == ""
