"""Queries over corners of matching, calls, writers and patterns."""

from __future__ import annotations

from .catalogue import _LINES, _PARTS, Query, _lines, grouped

QUERIES: dict[str, Query] = {
    # --- matching and calls ---
    "number_field": Query(
        ("part",), _PARTS, _lines("    match 1 num ' ' rest nl:\n        out.create('one', '$0 $1')\n    match num ' ' rest nl:\n        out.create('other', '$0')\n"), "SELECT k, name, text AS value FROM {n} WHERE depth = 1",
        """SELECT p_brand AS k, CASE WHEN p_partkey >= 10 AND CAST(p_partkey AS VARCHAR) LIKE '1%' THEN 'one' ELSE 'other' END AS name,
        CASE WHEN p_partkey >= 10 AND CAST(p_partkey AS VARCHAR) LIKE '1%' THEN '1 ' || substr(CAST(p_partkey AS VARCHAR), 2) ELSE CAST(p_partkey AS VARCHAR) END AS value FROM part""",
        columns=("depth", "name", "text"),
    ),
    "no_progress_stops": Query(
        ("customer",), "SELECT c_custkey AS k, concat(c_custkey, '\n', c_name, '\n') AS text FROM customer ", "grammar input:\n    match /\\d+/ /\\n/:\n        out.create('id', '$0')\n    when /C/:\n        out.add('seen', 'x')\n",
        "SELECT k, error, consumed, output FROM {n}",
        "SELECT c_custkey AS k, 'grammar ''input'' stopped at line 2 before the end of the input: \"' || c_name || '\\n\"' AS error, CAST(length(CAST(c_custkey AS VARCHAR)) + 1 AS BIGINT) AS consumed, CAST(NULL AS VARCHAR) AS output FROM customer",
        how="error consumed output",
    ),
    "no_match_warning": Query(
        ("customer",), "SELECT c_custkey AS k, concat(c_custkey, '\n', c_name, '\n') AS text FROM customer ", "grammar input:\n    match /\\d+/ /\\n/:\n        out.create('id', '$0')\n",
        "SELECT k, d.severity AS severity, d.message AS message FROM (SELECT k, explode(diagnostics) AS d FROM {n})",
        """SELECT c_custkey AS k, unnest(['info', 'warning']) AS severity,
        unnest(['match consumed ' || length(CAST(c_custkey AS VARCHAR)) + 1 || ' chars', 'no match found in grammar input, pos ' || length(CAST(c_custkey AS VARCHAR)) + 1]) AS message FROM customer""",
        how="diagnostics",
    ),
    # A node that is opened right before a call is left behind the call, without a trigger.
    "leave_after_call": Query(
        ("events",), grouped("events", "user_id", "event_id", "if(event_id % 2 = 0, concat('call\n', event_id, '\n'), concat('plain ', event_id, '\n'))", head="'head\n'"),
        """
define nl /\\n/
define num /\\d+/
grammar inner:
    match num nl:
        out.create('in', '$0')
        do.return()
grammar input:
    match 'head' nl:
        out.enqueue_on_leave_persist(/./, 'left', 'x')
    match 'call' nl:
        out.open('o')
        inner()
        out.create('never')
    match 'plain ' num nl:
        out.open('o')
        out.create('in', '$1')
""",
        "SELECT k, count_if(path = '/o') AS opened, count_if(path = '/o/in') AS inside, count_if(path = '/o/left') AS told, count(*) AS nodes FROM {n} GROUP BY k",
        "SELECT user_id AS k, count(*) AS opened, count(*) AS inside, count(*) FILTER (WHERE event_id % 2 = 1) AS told, 1 + 2 * count(*) + count(*) FILTER (WHERE event_id % 2 = 1) AS nodes FROM events GROUP BY user_id",
        columns=("path",),
    ),
    "fan_out": Query(
        ("lineitem",), grouped("lineitem", "l_orderkey % 50", "l_orderkey * 8 + l_linenumber", "concat(l_partkey, '\n')"), _lines("    match num nl:\n        out.add('part?id=\"$0\"', 'x')\n"),
        "SELECT k, cast(attrs[0].value as bigint) AS part, cast(length(text) as bigint) AS n FROM {n} WHERE depth = 1",
        "SELECT l_orderkey % 50 AS k, l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1, 2",
        columns=("depth", "text", "attrs"),
    ),
    # --- writers ---
    "xml_name_error": Query(
        ("part",), "SELECT p_partkey AS k, concat(p_partkey, ' ', p_brand, '\n') AS text FROM part ", _lines("    match num ' ' rest nl:\n        out.create('x$0')\n        out.create('$0')\n"), "SELECT k, error, output FROM {n}",
        "SELECT p_partkey AS k, 'unknown: runtime error: not an XML element name: \"' || p_partkey || '\"' AS error, CAST(NULL AS VARCHAR) AS output FROM part", how="error output", fmt="xml",
    ),
    "xml_attribute_name_error": Query(
        ("part",), "SELECT p_partkey AS k, concat(p_partkey, '\n') AS text FROM part ", _lines("    match num nl:\n        out.create('p')\n        out.add_attribute('p', '$0', 'v')\n"), "SELECT k, error FROM {n}",
        "SELECT p_partkey AS k, 'unknown: runtime error: not an XML attribute name: \"' || p_partkey || '\" (element <p>)' AS error FROM part", how="error output", fmt="xml",
    ),
    "yaml_long_key": Query(
        ("part",), "SELECT p_partkey AS k, concat('n', repeat(lower(replace(p_brand, '#', 'x')), if(p_partkey % 2 = 0, 20, 50)), ' ', p_partkey, '\n') AS text FROM part ",
        "grammar input:\n    match /\\w+/ ' ' /\\d+/ /\\n/:\n        out.create('$0', 'v$2')\n", "SELECT k, output FROM {n}",
        """WITH p AS (SELECT p_partkey, 'n' || repeat(lower(replace(p_brand, '#', 'x')), CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 50 END) AS n FROM part)
        SELECT p_partkey AS k, CASE WHEN length(n) > 250 THEN '? ' || n || chr(10) || ':' ELSE n || ':' END || chr(10) || '  ''#text'': v' || p_partkey || chr(10) AS output FROM p""",
        how="output", fmt="yaml",
    ),
    "execution_json_whole": Query(
        ("region",), "SELECT r_regionkey AS k, concat(r_name, '\n') AS text FROM region ", _LINES, "SELECT k, execution FROM {n}",
        """SELECT r_regionkey AS k, replace('{~  "consumed": ' || n || ',~  "actions": [~    {~      "name": "out.create",~      "args": [~        "line",~        "$0"~      ]~    }~  ],~  "traces": [~    "match consumed ' || n
        || ' chars"~  ],~  "capture_history": [~    [~      "' || r_name || '",~      "\\n"~    ]~  ],~  "capture_names_history": [~    [~      "",~      ""~    ]~  ],~  "error": null,~  "diagnostics": [~    {~      "severity": "info",~      "message": "match consumed ' || n
        || ' chars"~    }~  ],~  "output": {~    "line": {~      "#text": "' || r_name || '"~    }~  }~}', '~', chr(10)) AS execution FROM (SELECT *, length(r_name) + 1 AS n FROM region)""",
        how="execution",
    ),
    "execution_xml_whole": Query(
        ("region",), "SELECT r_regionkey AS k, concat(r_name, '\n') AS text FROM region ", _LINES, "SELECT k, execution FROM {n}",
        """SELECT r_regionkey AS k, replace('<?xml version="1.0" encoding="UTF-8"?>~<execution consumed="' || n || '">~  <actions>~    <action name="out.create">~      <args>~        <arg>line</arg>~        <arg>$0</arg>~      </args>~    </action>~  </actions>~  <traces>~    <trace>match consumed ' || n
        || ' chars</trace>~  </traces>~  <captures>~    <scope index="0">~      <value name="">' || r_name || '</value>~      <value name="">~</value>~    </scope>~  </captures>~  <output>~    <node name="">~      <node name="line">' || r_name || '</node>~    </node>~  </output>~  <error>~  </error>~</execution>', '~', chr(10)) AS execution
        FROM (SELECT *, length(r_name) + 1 AS n FROM region)""",
        how="execution", fmt="xml",
    ),
    "execution_yaml_whole": Query(
        ("region",), "SELECT r_regionkey AS k, concat(r_name, '\n') AS text FROM region ", _LINES, "SELECT k, execution FROM {n}",
        """SELECT r_regionkey AS k, replace('consumed: ' || n || '~actions:~  - name: out.create~    args:~      - line~      - $0~traces:~  - match consumed ' || n || ' chars~capture_history:~  - - ' || r_name
        || '~    - "\\n"~capture_names_history:~  - - ''''~    - ''''~error: null~diagnostics:~  - severity: info~    message: match consumed ' || n || ' chars~output:~  line:~    ''#text'': ' || r_name || '~', '~', chr(10)) AS execution FROM (SELECT *, length(r_name) + 1 AS n FROM region)""",
        how="execution", fmt="yaml",
    ),
    # --- patterns beyond ASCII ---
    "unicode_capitals": Query(
        ("documents",), "SELECT doc_id AS k, text FROM documents ", "grammar input:\n    match /\\p{Lu}[\\p{L}\\p{M}]*/:\n        out.add('all', '$0,')\n    skip /(?s:\\P{Lu}+)/\n", "SELECT k, md5(text) AS value FROM {n} WHERE name = 'all'",
        "SELECT doc_id AS k, md5(array_to_string(w, ',') || ',') AS value FROM (SELECT doc_id, regexp_extract_all(text, '\\p{Lu}[\\p{L}\\p{M}]*') AS w FROM documents) WHERE len(w) > 0",
        columns=("name", "text"),
    ),
    "unicode_words": Query(
        ("documents",), "SELECT doc_id AS k, text FROM documents ", "grammar input:\n    match /\\w+/:\n        out.add('all', '$0,')\n    skip /\\W+/\n", "SELECT k, md5(text) AS value FROM {n} WHERE name = 'all'",
        "SELECT doc_id AS k, md5(array_to_string(w, ',') || ',') AS value FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nl}\\p{Nd}\\p{Pc}]+') AS w FROM documents) WHERE len(w) > 0",
        columns=("name", "text"),
    ),
    "class_operations": Query(
        ("documents",), "SELECT doc_id AS k, text FROM documents ", "grammar input:\n    match /[\\p{L}&&[^aeiou]--[A-Z]]+/:\n        out.add('all', '$0,')\n    skip /(?s:.)/\n", "SELECT k, md5(text) AS value FROM {n} WHERE name = 'all'",
        "SELECT doc_id AS k, md5(array_to_string(w, ',') || ',') AS value FROM (SELECT doc_id, regexp_extract_all(text, '(?:[b-df-hj-np-tv-z]|[^\\x00-\\x7f\\PL])+') AS w FROM documents) WHERE len(w) > 0",
        columns=("name", "text"),
    ),
}
