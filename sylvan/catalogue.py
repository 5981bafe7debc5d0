"""The engine's operators as queries over relational tables.

Each query renders rows into text, parses that with a grammar, and flattens
the result.  The SQL beside it says the same of the original table, so that it
holds without any parser.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import linewise, parse, sql
from .plans.grammar import Grammar
from .sources import sinks
from .sources.files import read_texts
from .streaming.parse import stream_nodes

BIG_WINDOW = 1 << 24


def grouped(table: str, key: str, order: str, line: str, where: str = "true", head: str = "''", tail: str = "''") -> str:
    """SQL for a document of lines for each key, ordered by number and then by line."""
    lines = f"array_join(transform(array_sort(collect_list(struct(cast({order} as bigint) as o, {line} as l))), x -> x.l), '')"
    return f"SELECT {key} AS k, concat({head}, {lines}, {tail}) AS text FROM {table} WHERE {where} GROUP BY {key}"


@dataclass(frozen=True)
class Query:
    tables: tuple[str, ...]
    #: SQL over the tables that gives documents (k, text).
    render: str
    grammar: str
    #: SQL over {n}, what ``how`` gives of the documents.
    select: str
    oracle: str
    how: str = "nodes"
    fmt: str = "json"
    preserve_case: bool = False
    window: int | None = BIG_WINDOW
    #: Of the node table; all if None.
    columns: tuple[str, ...] | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        sql = self.render
        for t in self.tables:
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        docs = spark.sql(sql, **frames)
        g = Grammar.compile(self.grammar, preserve_case=self.preserve_case, search_window=self.window)
        if self.how == "nodes":
            got = parse.nodes(docs, g, ["k"], columns=self.columns)
        elif self.how in ("linewise", "lowered"):
            got = linewise.nodes(docs, g, ["k"], lower="always" if self.how == "lowered" else "auto", columns=self.columns)
        elif self.how in ("actions", "captures"):
            got = getattr(parse, self.how)(docs, g, ["k"])
        else:
            got = parse.parse(docs, g, fmt=self.fmt, columns=tuple(self.how.split()))
        return spark.sql(self.select, n=got)


_LINES = """
define nl /\\n/
define line /[^\\n]*/
grammar input:
    match line nl:
        out.create('line', '$0')
"""
_ITEMS = "SELECT k, ord, text AS value FROM {n} WHERE depth = 1"
_LINE_NODES = "SELECT k, ord, coalesce(text, '') AS line FROM {n} WHERE name = 'line'"

#: Rows of a customer's orders, in the order in which they are rendered.
_ORDERS = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders"
_EVENTS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events"
_KV = grouped("events", "user_id", "event_id", "concat(event_id, ' ', event_type, '\n')")
_PARTS = grouped("part", "p_brand", "p_partkey", "concat(p_partkey, ' ', p_type, '\n')")
_STATUS = grouped("orders", "o_custkey", "o_orderkey", "concat('status ', o_orderstatus, '\n order ', o_orderkey, '\n')")


def _lines(body: str, more: str = "") -> str:
    """A grammar over lines ``number blank rest``."""
    return f"define nl /\\n/\ndefine num /\\d+/\ndefine word /\\w+/\ndefine rest /[^\\n]*/\n{more}\ngrammar input:\n{body}"


QUERIES: dict[str, Query] = {
    # --- matching, captures, nodes ---
    "linesplit_nodes": Query(
        ("documents",), "SELECT doc_id AS k, concat(text, '\n') AS text FROM documents ", _LINES, _LINE_NODES,
        "SELECT doc_id AS k, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents",
        how="linewise",
    ),
    "linesplit_counts": Query(
        ("documents",), "SELECT doc_id AS k, concat(text, '\n') AS text FROM documents ", _LINES,
        "SELECT k, count(*) AS n_lines, count(text) AS n_full FROM {n} WHERE name = 'line' GROUP BY k",
        "SELECT doc_id AS k, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS n_full FROM documents",
        how="linewise",
        columns=('name', 'text'),
    ),
    "native_vs_kernel_linewise": Query(
        ("events",), _KV, _lines("    match num ' ' /[aeiou]\\w*/ nl:\n        out.create('vowel?id=\"$0\"', '$2')\n    match num ' ' word nl:\n        out.create('other?id=\"$0\"', '$2')\n"),
        "SELECT k, ord, name, text AS value, cast(get(attrs, 0).value as bigint) AS id FROM {n} WHERE depth = 1",
        f"""WITH e AS ({_EVENTS}), c AS (SELECT *, CASE WHEN regexp_matches(event_type, '^[aeiou]') THEN 'vowel' ELSE 'other' END AS name FROM e),
        f AS (SELECT *, min(i) OVER (PARTITION BY user_id, name) AS f FROM c)
        SELECT user_id AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, i) - 1 AS BIGINT) AS ord, name, event_type AS value, event_id AS id FROM f""",
        how="lowered",
    ),
    # Windows of bytes that end between characters.
    "linesplit_window_bytes": Query(
        ("documents",), "SELECT doc_id AS k, replace(text, '\n', ' ') AS text FROM documents",
        "grammar input:\n    match /[^\\n]+/:\n        out.create('line', '$0')\n", _LINE_NODES,
        """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, encode(replace(text, chr(10), ' ')) AS t FROM documents),
        e AS (SELECT r, doc_id, t, octet_length(t) AS n FROM d),
        c AS (SELECT r, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM e WHERE n > 0
        UNION ALL SELECT c.r, i + 1, b, least(n, b + 1000 + CASE WHEN hex(t[b + 1001:b + 1001]) NOT BETWEEN '80' AND 'BF' THEN 0
        WHEN hex(t[b + 1002:b + 1002]) NOT BETWEEN '80' AND 'BF' THEN 1 WHEN hex(t[b + 1003:b + 1003]) NOT BETWEEN '80' AND 'BF' THEN 2 ELSE 3 END)
        FROM c JOIN e ON c.r = e.r WHERE b < n)
        SELECT doc_id AS k, i AS ord, decode(t[a + 1:b]) AS line FROM c JOIN e ON c.r = e.r WHERE i >= 0""",
        window=None,
    ),
    "csv_columns": Query(
        ("orders",), grouped("orders", "o_custkey", "o_orderkey", "concat(o_orderkey, ',', o_orderstatus, ', ', o_orderpriority, '\n')"),
        """
define nl /\\n/
define cell /[^,\\n]*/
grammar line:
    match cell /, */:
        out.create('column', '$0')
    match cell nl:
        out.create('column', '$0')
        do.return()
grammar input:
    when /./:
        out.open('line')
        line()
""",
        # Ids go breadth first: the lines come right behind the root.
        "SELECT k, parent_id - 1 AS line_no, ord AS col_no, text AS value FROM {n} WHERE name = 'column'",
        f"""WITH o AS ({_ORDERS}) SELECT o_custkey AS k, CAST(i AS BIGINT) AS line_no, CAST(c.n AS BIGINT) AS col_no,
        CASE c.n WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS value FROM o, (SELECT unnest([0, 1, 2]) AS n) c""",
    ),
    "csv_quoted": Query(
        ("nation",), grouped("nation", "n_regionkey", "n_nationkey", "concat('\"', n_name, ', ', n_nationkey, '\",', n_nationkey, '\n')"),
        _lines("    match '\"' /[^\"\\n]*/ '\",' num nl:\n        out.create('row?key=\"$3\"', '$1')\n"),
        "SELECT k, text AS value, cast(attrs[0].value as bigint) AS key FROM {n} WHERE name = 'row'",
        "SELECT n_regionkey AS k, n_name || ', ' || n_nationkey AS value, CAST(n_nationkey AS BIGINT) AS key FROM nation",
    ),
    "user_records_attrs": Query(
        ("customer",), grouped("customer", "c_nationkey", "c_custkey", "concat('User\n----\nName: ', c_name, '\nSegment: ', c_mktsegment, '\n\n')"),
        """
define nl /\\n/
define name /[A-Z]\\w*/
define value /[^\\n]*/
grammar user:
    match name /: */ value nl:
        out.add('$0', '$2')
    match nl:
        do.return()
grammar input:
    match 'User' nl /-+/ nl 'Name: ' value nl:
        out.open('user')
        out.add_attribute('.', 'name', '$5')
        user()
""",
        "SELECT k, ord, attrs[0].key AS key, attrs[0].value AS value FROM {n} WHERE name = 'user'",
        "SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord, 'name' AS key, replace(c_name, '#', '%23') AS value FROM customer",
    ),
    "kv_path_attributes": Query(
        ("events",), grouped("events", "user_id", "event_id", "concat('user=', user_id, ' type=', event_type, '\n')"),
        _lines("    match 'user=' num ' type=' word nl:\n        out.create('event?user=\"$1\"&type=\"$3\"')\n"),
        "SELECT k, ord, attrs[0].value AS user, attrs[1].value AS type FROM {n} WHERE name = 'event'",
        f"SELECT user_id AS k, CAST(i AS BIGINT) AS ord, CAST(user_id AS VARCHAR) AS user, event_type AS type FROM ({_EVENTS})",
    ),
    "add_append_text": Query(
        ("orders",), grouped("orders", "o_custkey", "o_orderkey", "concat(o_orderkey, ' ', o_orderstatus, '\n')"),
        _lines("    match num ' ' word nl:\n        out.add('all', '$2$0 ')\n"), "SELECT k, text AS value FROM {n} WHERE name = 'all'",
        "SELECT o_custkey AS k, string_agg(o_orderstatus || o_orderkey || ' ', '' ORDER BY o_orderkey) AS value FROM orders GROUP BY o_custkey",
        columns=('name', 'text'),
    ),
    "create_vs_add_cardinality": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('made/$2')\n        out.add('found/$2')\n"),
        "SELECT k, count_if(path LIKE '/made/%') AS made, count_if(path LIKE '/found/%') AS found FROM {n} GROUP BY k",
        "SELECT user_id AS k, count(*) AS made, count(DISTINCT event_type) AS found FROM events GROUP BY user_id",
        columns=('path',),
    ),
    "replace_last_value": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.replace('last', '$2')\n        out.replace('of/$2', '$0')\n"),
        "SELECT k, path, text AS value FROM {n} WHERE text IS NOT NULL",
        """SELECT user_id AS k, '/last' AS path, arg_max(event_type, event_id) AS value FROM events GROUP BY 1
        UNION ALL SELECT user_id, '/of/' || event_type, CAST(max(event_id) AS VARCHAR) FROM events GROUP BY user_id, event_type""",
    ),
    "attribute_merge_last": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.add_attribute('.', '$2', '$0')\n"),
        "SELECT k, a.key AS key, cast(a.value as bigint) AS value, cast(at as bigint) AS ord FROM (SELECT k, posexplode(attrs) AS (at, a) FROM {n} WHERE node_id = 0)",
        "SELECT user_id AS k, event_type AS key, max(event_id) AS value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS BIGINT) AS ord FROM events GROUP BY user_id, event_type",
    ),
    "enter_reuse": Query(
        ("orders",), _STATUS, _lines("    match 'status ' word nl ' order ' num nl:\n        out.enter('status?of=\"$1\"')\n        out.create('order', '$4')\n"),
        "SELECT k, count_if(depth = 1) AS groups, count_if(depth = 2) AS orders FROM {n} GROUP BY k",
        "SELECT o_custkey AS k, count(DISTINCT o_orderstatus) AS groups, count(*) AS orders FROM orders GROUP BY o_custkey",
        columns=('depth',),
    ),
    "open_fresh": Query(
        ("orders",), _STATUS, _lines("    match 'status ' word nl ' order ' num nl:\n        out.open('status?of=\"$1\"')\n        out.create('order', '$4')\n"),
        "SELECT k, count_if(depth = 1) AS groups, count_if(depth = 2) AS orders FROM {n} GROUP BY k",
        "SELECT o_custkey AS k, count(*) AS groups, count(*) AS orders FROM orders GROUP BY o_custkey",
        columns=('depth',),
    ),
    "explicit_leave": Query(
        ("orders",), _STATUS,
        _lines("    match 'status ' word nl ' order ' num nl:\n        out.open('a')\n        out.open('b')\n        out.leave()\n        out.create('c', '$4')\n        out.leave()\n        out.create('d', '$1')\n"),
        "SELECT k, path, text AS value FROM {n} WHERE text IS NOT NULL",
        "SELECT o_custkey AS k, '/a/c' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_custkey, '/d', o_orderstatus FROM orders",
    ),
    "identity_attr_order": Query(
        ("part",), grouped("part", "p_brand", "p_partkey", "concat(p_size, ' ', p_partkey % 7, '\n')"),
        _lines("    match num ' ' num nl:\n        out.add('p?a=\"$0\"&b=\"$2\"')\n        out.add('p?b=\"$2\"&a=\"$0\"')\n"),
        "SELECT k, attrs[0].value AS a, attrs[1].value AS b FROM {n} WHERE name = 'p'",
        "SELECT DISTINCT p_brand AS k, CAST(p_size AS VARCHAR) AS a, CAST(p_partkey % 7 AS VARCHAR) AS b FROM part",
    ),
    "identity_newest_wins": Query(
        ("part",), grouped("part", "p_brand", "p_partkey", "concat(p_partkey, '\n')"), _lines("    match num nl:\n        out.create('p', '$0')\n        out.add('p', '!')\n"),
        _ITEMS, "SELECT p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord, p_partkey || '!' AS value FROM part",
    ),
    # --- calls, inheritance, control ---
    "nested_sections_3": Query(
        ("region", "nation", "supplier"),
        """SELECT 0 AS k, array_join(transform(array_sort(collect_list(x)), y -> y.l), '') AS text FROM (
          SELECT struct(r_regionkey AS a, -1 AS b, -1L AS c, concat('region ', r_name, '\n') AS l) AS x FROM region
          UNION ALL SELECT struct(n_regionkey, n_nationkey, -1L, concat(' nation ', n_name, '\n')) FROM nation
          UNION ALL SELECT struct(n_regionkey, n_nationkey, s_suppkey, concat('  supplier ', s_name, '\n')) FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
        """
define nl /\\n/
define name /[^\\n]+/
grammar supplier:
    match '  supplier ' name nl:
        out.create('supplier', '$1')
grammar nation:
    match ' nation ' name nl:
        out.enter('nation?name="$1"')
        supplier()
grammar input:
    match 'region ' name nl:
        out.enter('region?name="$1"')
        nation()
""",
        """SELECT r.attrs[0].value AS region, n.attrs[0].value AS nation, s.text AS supplier FROM {n} r JOIN {n} n ON r.node_id = n.parent_id AND r.name = 'region'
        JOIN {n} s ON n.node_id = s.parent_id""",
        "SELECT r_name AS region, n_name AS nation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "return_levels_statement": Query(
        ("nation",), grouped("nation", "n_regionkey", "n_nationkey", "concat(n_nationkey, '\n')", tail="'end\n'"),
        """
grammar c:
    match /\\d+/ /\\n/:
        out.create('n', '$0')
    match 'end' /\\n/:
        do.return(3)
grammar b:
    c()
    out.create('late')
grammar input:
    b()
    out.create('late')
""",
        "SELECT k, name, count(*) AS n FROM {n} WHERE depth = 1 GROUP BY k, name",
        "SELECT n_regionkey AS k, 'n' AS name, count(*) AS n FROM nation GROUP BY n_regionkey",
    ),
    "return_levels_action": Query(
        ("nation",), grouped("nation", "n_regionkey", "n_nationkey", "concat(n_nationkey, '\n')"),
        """
grammar one:
    match /\\d+/:
        out.create('n', '$0')
        do.return(5)
grammar input:
    when /\\d/:
        one()
        out.create('skipped')
    match /\\n/:
        out.create('line')
""",
        "SELECT k, name, count(*) AS n FROM {n} WHERE depth = 1 GROUP BY k, name",
        "SELECT n_regionkey AS k, unnest(['n', 'line']) AS name, count(*) AS n FROM nation GROUP BY n_regionkey",
    ),
    "when_lookahead": Query(
        ("orders",), grouped("orders", "o_custkey", "o_orderkey", "concat(o_orderstatus, ' ', o_orderkey, '\n')"),
        """
grammar final:
    match 'F ' /\\d+/ /\\n/:
        out.create('final', '$1')
        do.return()
grammar input:
    when 'F ':
        final()
    match /\\w+ / /\\d+/ /\\n/:
        do.skip()
        out.create('never')
""",
        "SELECT k, cast(text as bigint) AS orderkey FROM {n} WHERE depth = 1", "SELECT o_custkey AS k, o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'F'",
        columns=('depth', 'text'),
    ),
    "skip_comments": Query(
        ("events",), grouped("events", "user_id", "event_id", "if(event_id % 2 = 0, concat('# ', event_type, '\n'), concat(event_id, '\n'))"),
        "grammar input:\n    skip /#[^\\r\\n]*[\\r\\n]+/\n    match /\\d+/ /\\n/:\n        out.create('id', '$0')\n",
        "SELECT k, cast(text as bigint) AS id FROM {n} WHERE name = 'id'", "SELECT user_id AS k, event_id AS id FROM events WHERE event_id % 2 <> 0",
        columns=('name', 'text'),
    ),
    "skip_whitespace": Query(
        ("events",), grouped("events", "user_id", "event_id", "concat('  \n', event_id, ' \t')"), "grammar input:\n    skip /\\s+/\n    match /\\S+/:\n        out.create('id', '$0')\n",
        "SELECT k, cast(text as bigint) AS id FROM {n} WHERE name = 'id'", "SELECT user_id AS k, event_id AS id FROM events",
        columns=('name', 'text'),
    ),
    "alternation_first_match": Query(
        ("part",), _PARTS, _lines("    match num ' ' 'STANDARD' rest nl\n        | num ' ' 'S' rest nl:\n        out.create('s', '$2')\n    match num ' ' rest nl:\n        out.create('other', '$0')\n"),
        "SELECT k, name, text AS value FROM {n} WHERE depth = 1",
        """SELECT p_brand AS k, CASE WHEN p_type LIKE 'S%' THEN 's' ELSE 'other' END AS name,
        CASE WHEN p_type LIKE 'STANDARD%' THEN 'STANDARD' WHEN p_type LIKE 'S%' THEN 'S' ELSE CAST(p_partkey AS VARCHAR) END AS value FROM part""",
        columns=('name', 'depth', 'text'),
    ),
    "imatch_segment": Query(
        ("customer",), grouped("customer", "c_nationkey", "c_custkey", "concat(c_custkey, ' ', c_mktsegment, '\n')"),
        _lines("    imatch num ' building' nl:\n        out.create('b', '$0$1')\n    match num ' ' rest nl:\n        do.next()\n"), "SELECT k, text AS value FROM {n} WHERE name = 'b'",
        "SELECT c_nationkey AS k, c_custkey || ' ' || c_mktsegment AS value FROM customer WHERE lower(c_mktsegment) = 'building'",
    ),
    "define_alias": Query(
        ("part",), _PARTS, _lines("    match a ' ' rest nl:\n        out.create(tag, '$0')\n", "define a b\ndefine b num\ndefine tag 'p'"), "SELECT k, cast(text as bigint) AS partkey FROM {n} WHERE name = 'p'",
        "SELECT p_brand AS k, p_partkey AS partkey FROM part",
    ),
    "inheritance_parent_first": Query(
        ("part",), _PARTS,
        """
define nl /\\n/
grammar base:
    match /\\d*[02468]/ ' ' /[^\\n]*/ nl:
        out.create('even', '$0')
grammar input(base):
    match /\\d+/ ' ' /[^\\n]*/ nl:
        out.create('odd', '$0')
""",
        "SELECT k, name, cast(text as bigint) AS partkey FROM {n} WHERE depth = 1", "SELECT p_brand AS k, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS name, p_partkey AS partkey FROM part",
    ),
    "backreference_pairs": Query(
        ("lineitem",), grouped("lineitem", "l_orderkey", "l_linenumber", "concat(l_linenumber % 3, ' ', cast(l_quantity as int) % 3, '\n')"),
        _lines("    match num ' ' $0 nl:\n        out.create('same', '$0')\n    match num ' ' num nl:\n        out.create('other')\n"), "SELECT k, count_if(name = 'same') AS same, count_if(name = 'other') AS other FROM {n} GROUP BY k",
        "SELECT l_orderkey AS k, count(*) FILTER (WHERE l_linenumber % 3 = CAST(l_quantity AS INT) % 3) AS same, count(*) FILTER (WHERE l_linenumber % 3 <> CAST(l_quantity AS INT) % 3) AS other FROM lineitem GROUP BY l_orderkey",
    ),
    "named_backreference": Query(
        ("lineitem",), grouped("lineitem", "l_orderkey", "l_linenumber", "concat(l_returnflag, l_linenumber % 2, ' ', l_linenumber % 2, '\n')"),
        _lines("    match /[A-Z](?P<n>\\d)/ ' ' $n nl:\n        out.create('named', '$n')\n"), "SELECT k, cast(text as bigint) AS value, count(*) AS n FROM {n} WHERE name = 'named' GROUP BY k, text",
        "SELECT l_orderkey AS k, CAST(l_linenumber % 2 AS BIGINT) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2",
    ),
    "capture_inner_groups": Query(
        ("orders",), grouped("orders", "o_custkey", "o_orderkey", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' ', o_orderkey, '\n')"),
        _lines("    match /(\\d+)-(\\d+)-\\d+/ ' ' num nl:\n        out.create('o?y=\"$1\"&m=\"$2\"', '$4')\n"), "SELECT k, attrs[0].value AS y, attrs[1].value AS m, cast(text as bigint) AS orderkey FROM {n} WHERE name = 'o'",
        "SELECT o_custkey AS k, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, o_orderkey AS orderkey FROM orders",
    ),
    # --- strings and paths ---
    "interpolation_escapes": Query(
        ("part",), _PARTS, _lines("    match num ' ' rest nl:\n        out.create('p', '\\$0 is $0, $2px|$')\n"), "SELECT k, text AS value FROM {n} WHERE name = 'p'",
        "SELECT p_brand AS k, '$0 is ' || p_partkey || ', |$' AS value FROM part",
    ),
    "percent_roundtrip": Query(
        ("pages",), "SELECT page_id AS k, concat('<', coalesce(url, '')) AS text FROM pages ", "grammar input:\n    match '<' /(?s:.*)/:\n        out.create('u', '<$1> %41')\n", "SELECT k, text AS value FROM {n} WHERE name = 'u'",
        "SELECT page_id AS k, '<' || coalesce(url, '') || '> A' AS value FROM pages",
    ),
    "attr_percent_kept": Query(
        ("part",), grouped("part", "p_brand", "p_partkey", "concat(p_partkey, '/', p_size, '\n')"), _lines("    match /\\d+\\/\\d+/ nl:\n        out.create('p')\n        out.add_attribute('p', 'of', '$0')\n"),
        "SELECT k, ord, attrs[0].value AS value FROM {n} WHERE name = 'p'", "SELECT p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord, p_partkey || '%2F' || p_size AS value FROM part",
    ),
    "names_lowercased": Query(
        ("part",), _PARTS, _lines("    match num ' ' rest nl:\n        out.add('$2')\n"), "SELECT DISTINCT k, name FROM {n} WHERE depth = 1", "SELECT DISTINCT p_brand AS k, lower(replace(p_type, ' ', '-')) AS name FROM part",
    ),
    "names_preserve_case": Query(
        ("part",), _PARTS, _lines("    match num ' ' rest nl:\n        out.add('$2')\n"), "SELECT DISTINCT k, name FROM {n} WHERE depth = 1", "SELECT DISTINCT p_brand AS k, replace(p_type, ' ', '-') AS name FROM part", preserve_case=True,
    ),
    "path_quoted_slash": Query(
        ("part",), _PARTS, _lines("    match num ' ' rest nl:\n        out.create('a?x=\"1/$0\"/b', '$0')\n"), "SELECT a.k, a.attrs[0].value AS x, b.text AS value FROM {n} a JOIN {n} b ON a.k = b.k AND a.node_id = b.parent_id WHERE a.name = 'a'",
        "SELECT p_brand AS k, '1/' || p_partkey AS x, CAST(p_partkey AS VARCHAR) AS value FROM part",
    ),
    "dot_path": Query(
        ("part",), _PARTS, _lines("    match num ' ' rest nl:\n        out.open('p')\n        out.add('.', '$0')\n        out.add('./q', '$2')\n"), "SELECT k, path, text AS value FROM {n} WHERE depth > 0",
        "SELECT p_brand AS k, '/p' AS path, CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT p_brand, '/p/q', p_type FROM part",
    ),
    "empty_path_noop": Query(
        ("part",), _PARTS, _lines("    match num ' ' rest nl:\n        out.create('', '$0')\n        out.add('//', '$0')\n        out.replace('$9', 'x')\n        out.open('')\n        out.create('p')\n"),
        "SELECT k, count(*) - 1 AS n, count(text) AS n_text FROM {n} GROUP BY k", "SELECT p_brand AS k, count(*) AS n, CAST(0 AS BIGINT) AS n_text FROM part GROUP BY p_brand",
    ),
    # --- triggers ---
    "trigger_before": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('e', '$0')\n        out.enqueue_before(/./, 'b', '\\$0 ')\n"), "SELECT k, text AS value FROM {n} WHERE name = 'b'",
        f"SELECT user_id AS k, string_agg(event_id || ' ', '' ORDER BY event_id) AS value FROM ({_EVENTS}) WHERE i > 0 GROUP BY user_id",
        columns=('name', 'text'),
    ),
    "trigger_after": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.enqueue_after(/./, 'a?id=\"$0\"', '$2')\n"), "SELECT k, cast(attrs[0].value as bigint) AS id, text AS value FROM {n} WHERE name = 'a'",
        "SELECT user_id AS k, event_id AS id, event_type AS value FROM events",
    ),
    "trigger_on_add": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.enqueue_on_add(/./, 'mark', '$0')\n        out.create('e')\n"), "SELECT k, path, text AS value FROM {n} WHERE name = 'mark'",
        "SELECT user_id AS k, '/e/mark' AS path, CAST(event_id AS VARCHAR) AS value FROM events",
    ),
    "trigger_on_leave": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.open('e')\n        out.enqueue_on_leave(/./, 'left', '$0')\n"), "SELECT k, path, text AS value FROM {n} WHERE name = 'left'",
        "SELECT user_id AS k, '/e/left' AS path, CAST(event_id AS VARCHAR) AS value FROM events",
    ),
    "trigger_before_persist": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.enqueue_before_persist(/click/, 'seen', 'x')\n"), "SELECT k, cast(length(text) as bigint) AS n FROM {n} WHERE name = 'seen'",
        f"SELECT user_id AS k, CAST(sum(i) AS BIGINT) AS n FROM ({_EVENTS}) WHERE event_type LIKE '%click%' GROUP BY user_id HAVING sum(i) > 0",
    ),
    "trigger_after_persist": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.enqueue_after_persist(/click/, 'seen', 'x')\n"), "SELECT k, cast(length(text) as bigint) AS n FROM {n} WHERE name = 'seen'",
        f"SELECT user_id AS k, CAST(sum(i + 1) AS BIGINT) AS n FROM ({_EVENTS}) WHERE event_type LIKE '%click%' GROUP BY user_id",
    ),
    "trigger_on_add_persist": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('e')\n        out.enqueue_on_add_persist(/./, 'm', 'x')\n"), "SELECT k, sum(cast(length(text) as bigint)) AS n FROM {n} WHERE name = 'm' GROUP BY k",
        f"SELECT user_id AS k, CAST(sum(i) AS BIGINT) AS n FROM ({_EVENTS}) GROUP BY user_id HAVING sum(i) > 0",
    ),
    "trigger_on_leave_persist": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.open('e')\n        out.enqueue_on_leave_persist(/./, 'm', 'x')\n"), "SELECT k, sum(cast(length(text) as bigint)) AS n FROM {n} WHERE name = 'm' GROUP BY k",
        f"SELECT user_id AS k, CAST(sum(i + 1) AS BIGINT) AS n FROM ({_EVENTS}) GROUP BY user_id",
    ),
    "clear_queue": Query(
        ("events",), _KV, _lines("    match num ' ' /c\\w*/ nl:\n        out.clear_queue()\n    match num ' ' word nl:\n        out.enqueue_before(/./, 'b', 'x')\n"), "SELECT k, cast(length(text) as bigint) AS n FROM {n} WHERE name = 'b'",
        # An entry fires at the next match, whatever that is, so that clearing at it comes too late.
        f"SELECT user_id AS k, count(*) AS n FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE event_type NOT LIKE 'c%' AND nxt IS NOT NULL GROUP BY user_id",
    ),
    "trigger_reverse_order": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.enqueue_after(/./, 'a', '1')\n        out.enqueue_after(/./, 'a', '2')\n        out.enqueue_after(/./, 'a', '3')\n"), "SELECT k, text AS value FROM {n} WHERE name = 'a'",
        "SELECT user_id AS k, repeat('321', count(*)) AS value FROM events GROUP BY user_id",
    ),
    # --- control, errors, logs ---
    "do_next": Query(
        ("events",), _KV, _lines("    match num ' ' /c\\w*/ nl:\n        out.create('c', '$0')\n        do.next()\n        out.create('never')\n    match num ' ' word nl:\n        out.create('o', '$0')\n"),
        "SELECT k, name, cast(text as bigint) AS id FROM {n} WHERE depth = 1", "SELECT user_id AS k, CASE WHEN event_type LIKE 'c%' THEN 'c' ELSE 'o' END AS name, event_id AS id FROM events",
    ),
    "do_say_warn": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        do.say('id $0')\n        do.warn('of $2')\n"),
        "SELECT k, cast(size(filter(traces, t -> t LIKE 'say: id %')) as bigint) AS said, cast(size(filter(traces, t -> t LIKE 'warn: of %')) as bigint) AS warned, element_at(filter(traces, t -> t LIKE 'say%'), 1) AS first FROM {n}",
        "SELECT user_id AS k, count(*) AS said, count(*) AS warned, 'say: id ' || min(event_id) AS first FROM events GROUP BY user_id", how="traces",
    ),
    "do_fail_permissive": Query(
        ("orders",), grouped("orders", "o_custkey", "o_orderkey", "concat(o_orderkey, ' ', o_orderstatus, '\n')"), _lines("    match num ' P' nl:\n        do.fail('pending $0')\n    match num ' ' word nl:\n        out.create('o')\n"),
        "SELECT k, error, output IS NULL AS failed FROM {n}", "SELECT o_custkey AS k, 'pending ' || min(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS error, count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS failed FROM orders GROUP BY o_custkey",
        how="error output",
    ),
    "unconsumed_error_line": Query(
        ("orders",), grouped("orders", "o_custkey", "o_orderkey", "concat(o_orderkey, ' ', o_orderstatus, '\n')"), _lines("    match num ' ' /[^P\\n]/ nl:\n        out.create('o')\n"),
        "SELECT k, error FROM {n} WHERE error IS NOT NULL",
        f"""WITH o AS ({_ORDERS}), p AS (SELECT o_custkey, min(i) AS i FROM o WHERE o_orderstatus = 'P' GROUP BY o_custkey),
        r AS (SELECT o.o_custkey, p.i, string_agg(o_orderkey || ' ' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS rest FROM o JOIN p ON o.o_custkey = p.o_custkey AND o.i >= p.i GROUP BY 1, 2)
        SELECT o_custkey AS k, 'grammar ''input'' stopped at line ' || (i + 1) || ' before the end of the input: "' || replace(left(rest, 40), chr(10), '\\n') || '"' AS error FROM r""",
        how="error",
    ),
    "depth_limit": Query(
        ("region",), "SELECT r_regionkey AS k, concat(r_name, '\n') AS text FROM region ", "grammar deep:\n    match /[A-Z]/:\n        deep()\n    deep()\ngrammar input:\n    deep()\n", "SELECT k, error FROM {n}",
        "SELECT r_regionkey AS k, 'grammar calls nested more than 250 levels deep (calling ''deep'' at line 1)' AS error FROM region", how="error",
    ),
    "consumed_bytes": Query(
        ("documents",), "SELECT doc_id AS k, concat(text, '\n') AS text FROM documents ", _LINES, "SELECT k, consumed, error FROM {n}",
        "SELECT doc_id AS k, CAST(strlen(text) + 1 AS BIGINT) AS consumed, CAST(NULL AS VARCHAR) AS error FROM documents", how="consumed error",
    ),
    "diagnostics_counts": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('e')\n"), "SELECT k, d.severity AS severity, d.message AS message, count(*) AS n FROM (SELECT k, explode(diagnostics) AS d FROM {n}) GROUP BY 1, 2, 3",
        "SELECT user_id AS k, 'info' AS severity, 'match consumed ' || strlen(event_id || ' ' || event_type || chr(10)) || ' chars' AS message, count(*) AS n FROM events GROUP BY 1, 2, 3", how="diagnostics",
    ),
    "actions_table": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create($2, $0)\n        my.own('$0')\n"), "SELECT k, seq, name, args[0] AS first FROM {n}",
        f"SELECT user_id AS k, CAST(2 * i + n AS BIGINT) AS seq, CASE n WHEN 0 THEN 'out.create' ELSE 'my.own' END AS name, CASE n WHEN 0 THEN event_type ELSE '$0' END AS first FROM ({_EVENTS}), (SELECT unnest([0, 1]) AS n)",
        how="actions",
    ),
    "captures_table": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('e')\n"), "SELECT k, match_seq, value FROM {n} WHERE idx = 2", f"SELECT user_id AS k, CAST(i AS BIGINT) AS match_seq, event_type AS value FROM ({_EVENTS})", how="captures",
    ),
    "execution_json": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('e')\n"),
        "SELECT k, cast(get_json_object(execution, '$.consumed') as bigint) AS consumed, cast(size(from_json(get_json_object(execution, '$.traces'), 'array<string>')) as bigint) AS n FROM {n}",
        "SELECT user_id AS k, CAST(sum(strlen(event_id || ' ' || event_type || chr(10))) AS BIGINT) AS consumed, count(*) AS n FROM events GROUP BY user_id", how="execution",
    ),
    "execution_xml": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('e')\n"),
        "SELECT k, cast(regexp_extract(execution, 'consumed=\"(\\\\d+)\"', 1) as bigint) AS consumed, cast(size(split(execution, '<trace>')) - 1 as bigint) AS n FROM {n}",
        "SELECT user_id AS k, CAST(sum(strlen(event_id || ' ' || event_type || chr(10))) AS BIGINT) AS consumed, count(*) AS n FROM events GROUP BY user_id", how="execution", fmt="xml",
    ),
    "execution_yaml": Query(
        ("events",), _KV, _lines("    match num ' ' word nl:\n        out.create('e')\n"),
        "SELECT k, cast(regexp_extract(execution, '^consumed: (\\\\d+)\n', 1) as bigint) AS consumed, cast(size(split(execution, '\n  - match consumed')) - 1 as bigint) AS n FROM {n}",
        "SELECT user_id AS k, CAST(sum(strlen(event_id || ' ' || event_type || chr(10))) AS BIGINT) AS consumed, count(*) AS n FROM events GROUP BY user_id", how="execution", fmt="yaml",
    ),
    # --- serializers and the node table ---
    "json_output": Query(
        ("nation",), grouped("nation", "n_regionkey", "n_nationkey", "concat(n_nationkey, ' ', n_name, '\n')"), _lines("    match num ' ' rest nl:\n        out.create('n?id=\"$0\"', '$2')\n"), "SELECT k, output FROM {n}",
        """SELECT n_regionkey AS k, '{' || chr(10) || '    "n": [' || string_agg(chr(10) || '        {' || chr(10) || '            "@id": "' || n_nationkey || '",' || chr(10) || '            "#text": "' || n_name || '"' || chr(10) || '        }', ',' ORDER BY n_nationkey)
        || chr(10) || '    ]' || chr(10) || '}' AS output FROM nation GROUP BY n_regionkey""",
        how="output",
    ),
    "xml_output": Query(
        ("nation",), grouped("nation", "n_regionkey", "n_nationkey", "concat(n_nationkey, ' ', n_name, '\n')"), _lines("    out.set_root_name('nations')\n    match num ' ' rest nl:\n        out.create('n?id=\"$0\"', '$2')\n        out.create('n')\n"), "SELECT k, output FROM {n}",
        """SELECT n_regionkey AS k, '<nations>' || chr(10) || string_agg('  <n id="' || n_nationkey || '">' || n_name || '</n>' || chr(10) || '  <n/>' || chr(10), '' ORDER BY n_nationkey) || '</nations>' || chr(10) AS output FROM nation GROUP BY n_regionkey""",
        how="output", fmt="xml",
    ),
    "yaml_output": Query(
        ("nation",), grouped("nation", "n_regionkey", "n_nationkey", "concat(n_nationkey, ' ', n_name, '\n')"), _lines("    match num ' ' rest nl:\n        out.create('n?id=\"$0\"', 'is $2')\n"), "SELECT k, output FROM {n}",
        """SELECT n_regionkey AS k, '''n'':' || chr(10) || string_agg('- ''@id'': ''' || n_nationkey || '''' || chr(10) || '  ''#text'': is ' || n_name || chr(10), '' ORDER BY n_nationkey) AS output FROM nation GROUP BY n_regionkey""",
        how="output", fmt="yaml",
    ),
    "none_output": Query(
        ("nation",), grouped("nation", "n_regionkey", "n_nationkey", "concat(n_name, '\n')"), _LINES, "SELECT k, output, error FROM {n}", "SELECT DISTINCT n_regionkey AS k, '' AS output, CAST(NULL AS VARCHAR) AS error FROM nation",
        how="output error", fmt="none",
    ),
    "xml_escape": Query(
        ("pages",), "SELECT page_id AS k, concat('.', coalesce(html, '')) AS text FROM pages ", "grammar input:\n    match /(?s).+/:\n        out.create('h', '$0')\n", "SELECT k, output FROM {n}",
        "SELECT page_id AS k, '<xml>' || chr(10) || '  <h>' || replace(replace(replace(replace('.' || coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;') || '</h>' || chr(10) || '</xml>' || chr(10) AS output FROM pages",
        how="output", fmt="xml",
    ),
    "json_escape": Query(
        ("pages",), "SELECT page_id AS k, concat('.', coalesce(html, '')) AS text FROM pages ", "grammar input:\n    match /(?s).+/:\n        out.create('h', '$0')\n", "SELECT k, output FROM {n}",
        """SELECT page_id AS k, '{' || chr(10) || '    "h": {' || chr(10) || '        "#text": "' || replace(replace(replace(replace(replace('.' || coalesce(html, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"' || chr(10) || '    }' || chr(10) || '}' AS output FROM pages""",
        how="output",
    ),
    "yaml_quote": Query(
        ("pages",), "SELECT page_id AS k, concat('.', coalesce(url, '')) AS text FROM pages ", "grammar input:\n    match /(?s).+/:\n        out.create('u', '$0')\n        out.create('w', '\\'$0')\n", "SELECT k, output FROM {n}",
        r"""WITH p AS (SELECT page_id, '.' || coalesce(url, '') AS u, '\''.' || coalesce(url, '') AS w FROM pages),
        q AS (SELECT page_id, unnest([0, 1]) AS o, unnest(['u', 'w']) AS n, unnest([u, w]) AS v FROM p),
        y AS (SELECT *, CASE WHEN regexp_matches(v, '[\x00-\x1f]') THEN '"' || replace(replace(replace(replace(replace(v, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' ELSE '''' || replace(v, '''', '''''') || '''' END AS s FROM q)
        SELECT page_id AS k, string_agg(n || ':' || chr(10) || '  ''#text'': ' || s || chr(10), '' ORDER BY o) AS output FROM y GROUP BY page_id""",
        how="output", fmt="yaml",
    ),
    "children_grouping_order": Query(
        ("orders",), grouped("orders", "o_custkey", "o_orderkey", "concat(o_orderkey, ' ', o_orderstatus, '\n')"), _lines("    match num ' ' word nl:\n        out.create('$2', '$0')\n"), "SELECT k, ord, node_id, name, cast(text as bigint) AS orderkey FROM {n} WHERE depth = 1",
        f"""WITH o AS ({_ORDERS}), f AS (SELECT *, min(i) OVER (PARTITION BY o_custkey, o_orderstatus) AS f FROM o), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY f, i) AS BIGINT) AS r FROM f)
        SELECT o_custkey AS k, r - 1 AS ord, r AS node_id, lower(o_orderstatus) AS name, o_orderkey AS orderkey FROM r""",
    ),
    "node_depth_paths": Query(
        ("supplier",), grouped("supplier", "s_nationkey", "s_suppkey", "concat(s_suppkey, ' ', s_name, '\n')"), _lines("    match num ' ' rest nl:\n        out.create('nation/supplier/name', '$2')\n"), "SELECT k, depth, path, count(*) AS n FROM {n} GROUP BY k, depth, path",
        """WITH p AS (SELECT unnest([0, 1, 2, 3]) AS d, unnest(['', '/nation', '/nation/supplier', '/nation/supplier/name']) AS p), c AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1)
        SELECT s_nationkey AS k, CAST(d AS BIGINT) AS depth, p AS path, CASE WHEN d < 3 THEN 1 ELSE c END AS n FROM c, p""",
    ),
    "tree_pivot": Query(
        ("supplier",), grouped("supplier", "s_nationkey", "s_suppkey", "concat(s_suppkey, ' ', s_name, '\n')"), _lines("    match num ' ' rest nl:\n        out.open('s')\n        out.create('id', '$0')\n        out.create('name', '$2')\n"),
        "SELECT k, cast(max(text) FILTER (WHERE name = 'id') as bigint) AS id, max(text) FILTER (WHERE name = 'name') AS name FROM {n} WHERE depth = 2 GROUP BY k, parent_id",
        "SELECT s_nationkey AS k, s_suppkey AS id, s_name AS name FROM supplier",
    ),
    # --- texts as they are ---
    "html_titles": Query(
        ("pages",), "SELECT page_id AS k, coalesce(html, '') AS text FROM pages ", "grammar input:\n    skip /(?s:[^<]+)/\n    match '<title>' /[^<]*/ '</title>':\n        out.create('title', '$1')\n    skip '<'\n",
        "SELECT k, ord, coalesce(text, '') AS title FROM {n} WHERE name = 'title'",
        "SELECT page_id AS k, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS ord, unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(html, '<title>([^<]*)</title>', 1) AS t FROM pages)",
    ),
    "html_links": Query(
        ("pages",), "SELECT page_id AS k, coalesce(html, '') AS text FROM pages ", "grammar input:\n    skip /[^<]+/\n    match '<a href=\"' /[^\"]*/ '\"':\n        out.create('a', '$1')\n    skip '<'\n",
        "SELECT k, coalesce(text, '') AS href, count(*) AS n FROM {n} WHERE name = 'a' GROUP BY 1, 2",
        "SELECT k, href, count(*) AS n FROM (SELECT page_id AS k, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY k, href",
        columns=("name", "text"),
    ),
    "event_props": Query(
        ("events",), grouped("events", "user_id", "event_id", "concat(event_id, ' ', props, '\n')"), _lines("    match num ' {\"k\": ' num '}' nl:\n        out.create('p?id=\"$0\"', '$2')\n"), "SELECT k, cast(attrs[0].value as bigint) AS id, cast(text as bigint) AS value FROM {n} WHERE name = 'p'",
        "SELECT user_id AS k, event_id AS id, CAST(regexp_extract(props, '\\{\"k\": (\\d+)\\}', 1) AS BIGINT) AS value FROM events",
    ),
    "transcript_turns": Query(
        ("conversations",), grouped("conversations", "conv_id", "turn", "concat(coalesce(role, '?'), ': ', replace(coalesce(text, ''), '\n', ' '), '\n')"),
        "grammar input:\n    match /[\\w?]+/ ': ' /[^\\n]*/ /\\n/:\n        out.open('turn')\n        out.add_attribute('.', 'role', '$0')\n        out.add('.', '$2')\n", "SELECT k, attrs[0].value AS role, coalesce(text, '') AS text, count(*) AS n FROM {n} WHERE name = 'turn' GROUP BY ALL",
        "SELECT conv_id AS k, CASE WHEN role IS NULL THEN '%3F' ELSE role END AS role, replace(coalesce(text, ''), chr(10), ' ') AS text, count(*) AS n FROM conversations GROUP BY ALL",
    ),
}


_EVENT = _lines("    match num ' ' word nl:\n        out.create('e?id=\"$0\"', '$2')\n")


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share: that of
    ``spark.checkpoint.dir``, which only a single machine can do without.  It
    goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sylvan-")
    path = f"{base.rstrip('/')}/sylvan-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def streaming_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse a stream of the events and read back what it appended."""
    base = scratch(spark)
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.selectExpr("event_id", "concat(event_id, ' ', event_type, '\n') AS value").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("event_id bigint, value string").parquet(f"{base}/in")
    stream_nodes(stream, Grammar.compile(_EVENT), ["event_id"], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    return got.where("name = 'e'").selectExpr("event_id", "attrs[0].value AS id", "text AS value")


#: Lines of a file that is read whole, as one document with one tree.
FILE_LINES = 100_000


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write files of events for each type, of at most FILE_LINES lines, read the files whole, and parse them."""
    base = scratch(spark)
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.selectExpr("event_type", "concat(event_id, ' ', event_type) AS line").write.option("maxRecordsPerFile", FILE_LINES).partitionBy("event_type").text(f"{base}/files")
    docs = read_texts(spark, f"{base}/files/event_type=*/*.txt")
    return parse.nodes(docs, Grammar.compile(_EVENT), ["file"], columns=("name", "text", "attrs")).where("name = 'e'").selectExpr("cast(attrs[0].value as bigint) AS id", "text AS value")


def write_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write outputs as text files, and read their lines."""
    base = scratch(spark)
    table = spark.read.parquet(f"{sf_dir}/region.parquet")
    sinks.write_outputs(table.selectExpr("concat(r_name, '\n') AS text"), Grammar.compile(_LINES), f"{base}/out", "yaml")
    return spark.read.text(f"{base}/out").where("value <> ''").selectExpr("value AS line")


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grammar as a function in SQL."""
    sql.register_function(spark, "region_lines", Grammar.compile(_LINES), "xml")
    return spark.sql("SELECT r_regionkey AS k, region_lines(concat(r_name, '\n')) AS output FROM {r}", r=spark.read.parquet(f"{sf_dir}/region.parquet"))


def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grammar as a table function in a lateral join."""
    sql.register_table_function(spark, "event_nodes", Grammar.compile(_EVENT))
    query = "SELECT e.event_id, n.attrs[0].value AS id, n.text AS value FROM {e} e, LATERAL event_nodes(concat(e.event_id, ' ', e.event_type, '\n')) n WHERE n.depth = 1"
    return spark.sql(query, e=spark.read.parquet(f"{sf_dir}/events.parquet"))


def sql_nodes_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grammar as a function that gives arrays of nodes, in batches of texts."""
    sql.register_nodes_function(spark, "event_node_array", Grammar.compile(_EVENT))
    query = "SELECT e.event_id, n.attrs[0].value AS id, n.text AS value FROM {e} e LATERAL VIEW inline(event_node_array(concat(e.event_id, ' ', e.event_type, '\n'))) n WHERE n.depth = 1"
    return spark.sql(query, e=spark.read.parquet(f"{sf_dir}/events.parquet"))


_FUNCTIONS = {f.__name__: f for f in (streaming_parse, whole_files, write_outputs, sql_function, sql_table_function, sql_nodes_function)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_corners, catalogue_language

    return {**QUERIES, **catalogue_corners.QUERIES, **_FUNCTIONS, **{name: f for name, (f, _) in catalogue_language.QUERIES.items()}}


def oracle_sql() -> dict[str, str]:
    from . import catalogue_corners, catalogue_language

    more = {name: query for name, (_, query) in catalogue_language.QUERIES.items()}
    return {name: q.oracle for name, q in (QUERIES | catalogue_corners.QUERIES).items()} | more | {
        "streaming_parse": "SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS value FROM events",
        "whole_files": "SELECT event_id AS id, event_type AS value FROM events",
        "write_outputs": "SELECT unnest(['line:', '  ''#text'': ' || r_name]) AS line FROM region",
        "sql_function": "SELECT r_regionkey AS k, '<xml>' || chr(10) || '  <line>' || r_name || '</line>' || chr(10) || '</xml>' || chr(10) AS output FROM region",
        "sql_nodes_function": "SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS value FROM events",
        "sql_table_function": "SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS value FROM events",
    }
