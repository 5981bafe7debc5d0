import glob
import os
import subprocess
import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import sylvan
from sylvan import catalogue, catalogue_language
from sylvan.errors import ParsingFailed
from sylvan.functions import text as tx
from sylvan.operators import linewise, parse, sql
from sylvan.plans.grammar import Grammar
from sylvan.sources import files, sinks
from sylvan.streaming.parse import parse_stream, read_text_stream

LINES = "define nl /\\n/\ngrammar input:\n    match /[A-Z]\\w*/ /[^\\n]*/ nl:\n        out.create('cap?first=\"$0\"', '$0$1')\n    match /[^\\n]*/ nl:\n        out.create('line', '$0')\n"
TEXTS = ["", "a\n", "Ab c\n\nd\nEf\n", "no end", "x\r\ny\n", "É é\nÀ%2F$0\n", "L" + "o" * 2000 + "ng\n", None, "A\n"]
EDGES = ["", "a b~/", "é%", "%41%zz%", "+*%2B", "100%", "%%41", "%c3%28", "中 文", "a%", "%4"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, text string")


def test_lowered_and_kernel_nodes_agree(docs):
    g = Grammar.compile(LINES)
    assert linewise.line_rules(g)
    rows = lambda df: sorted(map(str, df.collect()))
    for lower in ("auto", "always", "never"):
        assert rows(linewise.nodes(docs, g, ["k"], lower=lower)) == rows(parse.nodes(docs, g, ["k"]))
    with pytest.raises(ValueError, match="lowering"):
        linewise.nodes(docs, g, ["k"], lower="x")


@pytest.mark.parametrize(
    "body",
    [
        "    skip /x/\n",
        "    match /.*/ nl:\n        other()\n",
        "    match /(?s).*/ nl:\n        out.create('a')\n",
        "    match /[^a]*/ nl:\n        out.create('a')\n",
        "    match /^a/ nl:\n        out.create('a')\n",
        "    match /a/ /(?:\\r?\\n)+/:\n        out.create('a')\n",
        "    match /a/:\n        out.create('a')\n",
        "    match /a/ nl:\n        out.create('$0')\n",
        "    match /a/ nl:\n        out.create('a', '%41')\n",
        "    when /a/ nl:\n        out.create('a')\n",
        "    match /a/ $0 nl:\n        out.create('a')\n",
    ],
)
def test_grammars_that_need_the_kernel(body):
    assert linewise.line_rules(Grammar.compile("define nl /\\n/\ngrammar input:\n" + body)) is None


def test_modes(docs):
    g = Grammar.compile(LINES)
    got = parse.parse(docs, g, columns=("error", "output", "consumed"))
    by = {r.k: r for r in got.collect()}
    assert by[1].error is None and by[1].output == '{\n    "line": {\n        "#text": "a"\n    }\n}'
    assert "stopped at line 1" in by[3].error and by[3].output is None and by[7].error is None and by[7].consumed is None
    assert {r.k for r in parse.parse(docs, g, mode="DROPMALFORMED").collect()} == {k for k, r in by.items() if r.error is None and TEXTS[k] is not None}
    with pytest.raises(Exception, match="stopped at line 1"):
        parse.parse(docs, g, mode="FAILFAST").collect()
    with pytest.raises(Exception, match="stopped at line 1"):
        parse.nodes(docs, g, ["k"], mode="failfast").collect()
    assert parse.nodes(docs, g, ["k"], mode="DROPMALFORMED").select("k").distinct().count() == sum(r.error is None for r in by.values()) - 1
    assert sinks.malformed(docs, g).count() == sum(r.error is not None for r in by.values())
    for bad in (dict(mode="x"), dict(fmt="csv"), dict(start="nobody")):
        with pytest.raises(ValueError):
            parse.parse(docs, g, **bad)


def test_an_xml_name_error_is_a_row_s_error(spark):
    g = Grammar.compile("grammar input:\n    match /.+/:\n        out.create('$0')\n")
    rows = parse.parse(spark.createDataFrame([("1a",), ("ab",)], "text string"), g, fmt="xml").collect()
    assert [r.error is None for r in rows] == [False, True] and 'not an XML element name: "1a"' in rows[0].error


def test_only_asked_columns_and_pushdown(spark, tmp_path):
    spark.createDataFrame([(1, "en", "a\n"), (2, "de", "b\n")], "k int, lang string, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = parse.parse(df, Grammar.compile(LINES)).where("lang = 'en'")._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan
    pruned = parse.parse(df, Grammar.compile(LINES)).select("k")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in pruned
    native = linewise.nodes(df.where("text like '%\n'"), Grammar.compile(LINES), ["k"], lower="always")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in native


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a\n", "mine")], "k int, text string, Output string")
    assert parse.parse(df, Grammar.compile(LINES)).columns == ["k", "text", "consumed", "error", "output"]


def test_clashing_keys_are_an_error(docs):
    for nodes in (parse.nodes, linewise.nodes):
        with pytest.raises(ValueError, match="named like"):
            nodes(docs.withColumnRenamed("k", "Path"), Grammar.compile(LINES), ["Path"])


def test_attributes_and_variants(docs):
    g = Grammar.compile(LINES)
    caps = parse.nodes(docs, g, ["k"]).where("name = 'cap'").select(parse.attribute("first").alias("f"))
    assert {r.f for r in caps.collect()} == {"A", "Ab", "Ef"}
    got = parse.parse(docs.where("k = 2"), g).select(F.variant_get(parse.variant(), "$.cap[1].@first", "string").alias("f")).first()
    assert got.f == "Ef"


def test_text_functions(spark):
    df = spark.createDataFrame([(e,) for e in EDGES], "s string")
    for r in df.select("s", tx.percent_encoded(F.col("s")).alias("e"), tx.normalized_name(F.col("s")).alias("n"), tx.line_of(F.col("s"), F.length("s")).alias("l")).collect():
        assert r.e == tx.percent_encode(r.s) and r.n == tx.normalize_name(r.s) and r.l == 1
    for s in EDGES:
        assert tx.percent_decode(tx.percent_encode(s)) == s
    good = [s for s in EDGES if tx.percent_decode(s) != s or "%" not in s]
    got = spark.createDataFrame([(e,) for e in ["a%2Fb", "+", "%41"]], "s string").select("s", tx.percent_decoded(F.col("s")).alias("d")).collect()
    assert good and all(r.d == tx.percent_decode(r.s) for r in got)


def test_files_and_streams(spark, tmp_path):
    for i, t in enumerate(["a\n", "B c\n"]):
        (tmp_path / f"{i}.txt").write_text(t)
    df = files.read_texts(spark, f"{tmp_path}/*.txt")
    assert {r.text for r in df.collect()} == {"a\n", "B c\n"}
    g = Grammar.compile(LINES)
    sinks.write_outputs(df, g, f"{tmp_path}/out")
    assert sum("cap" in open(f).read() for f in glob.glob(f"{tmp_path}/out/part*")) == 1
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="(?i)utf"):
        files.read_texts(spark, f"{tmp_path}/bad.bin").collect()
    assert files.read_texts(spark, f"{tmp_path}/bad.bin", strict=False).count() == 1
    with pytest.raises(ValueError):
        files.read_texts(spark, f"{tmp_path}", encoding="latin-1")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.txt").write_text("B c\n")
    q = parse_stream(read_text_stream(spark, f"{tmp_path}/s"), g).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.error for r in spark.sql("select error from parsed").collect()] == [None]


def test_single_texts(tmp_path):
    (tmp_path / "g.grammar").write_text(LINES)
    (tmp_path / "in.txt").write_text("a\n")
    c = sylvan.compile(str(tmp_path / "g.grammar"))
    assert sylvan.generate(c, str(tmp_path / "in.txt")) == "<xml>\n  <line>a</line>\n</xml>\n"
    sylvan.generate_to_file(c, str(tmp_path / "in.txt"), str(tmp_path / "o.json"), "json")
    assert '"line"' in (tmp_path / "o.json").read_text()
    with pytest.raises(RuntimeError):
        sylvan.generate_string_to_file(c, "no end", str(tmp_path / "p"))
    assert not os.path.exists(tmp_path / "p")
    with pytest.raises(ParsingFailed):
        sylvan.generate_string(c, "no end")
    with pytest.raises(OSError):
        sylvan.generate(c, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sylvan.compile(str(tmp_path / "g.grammar"), encoding="latin-1")
    assert '"error": "grammar' in c.run("no end") and c.run_xml("a\n").startswith("<?xml")


def test_command_line(tmp_path):
    (tmp_path / "g.grammar").write_text(LINES)
    (tmp_path / "1.txt").write_text("a\n")
    (tmp_path / "2.txt").write_text("no end")
    cli = lambda *a, **k: subprocess.run([sys.executable, "-m", "sylvan.cli", "-s", tmp_path / "g.grammar", *a], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), **k)
    got = cli("-f", "yml", tmp_path / "1.txt", tmp_path / "2.txt")
    assert got.returncode == 1 and got.stdout == "line:\n  '#text': a\n" and "stopped" in got.stderr
    assert cli(input="B\n").stdout == '<xml>\n  <cap first="B">B</cap>\n</xml>\n'
    assert cli("--search-window", "0").returncode == 1


def test_sql_functions(spark, docs):
    from sylvan.operators import sql

    g = Grammar.compile(LINES)
    sql.register_function(spark, "lines_json", g)
    sql.register_function(spark, "lines_strict", g, strict=True)
    sql.register_table_function(spark, "lines_nodes", g)
    docs.createOrReplaceTempView("docs")
    got = {r.k: r.o for r in spark.sql("SELECT k, lines_json(text) AS o FROM docs").collect()}
    want = {r.k: r.output for r in parse.parse(docs, g).collect()}
    assert got == want
    with pytest.raises(Exception, match="stopped at line 1"):
        spark.sql("SELECT lines_strict(text) FROM docs").collect()
    rows = sorted(map(str, spark.sql("SELECT d.k, n.* FROM docs d, LATERAL lines_nodes(d.text) n").collect()))
    assert rows == sorted(map(str, parse.nodes(docs, g, ["k"]).collect()))


@pytest.mark.parametrize(
    "body",
    [
        "    match /[^\\r\\n]*/ nl:\n        out.create('line', '<$0>')\n",
        "    match /[^\\n]*/ nl:\n        out.create('A b?x=\"$0\"')\n        out.create('c', '$0$1$2')\n        out.create('a-b', 'k')\n",
        "    match /b+/ /\\w*/ nl:\n        out.create('z', '$1')\n    match /(\\d)(\\d)?/ nl | 'x' /.*/ nl:\n        out.create('y?n=\"$2\"&m=\"$0\"', '$1')\n        out.create('z', '$0')\n    match /.*/ nl:\n        out.create('w', '$0')\n    match /b/ nl:\n        out.create('never')\n",
        "    imatch 'ab' /\\d*/ nl:\n        out.create('i', '$0')\n    match /\\w*/ nl:\n        out.create('j', '$0')\n        out.create('i')\n",
        "    match /a?/ nl:\n        out.create('only', '$0')\n",
    ],
)
def test_lowered_grammars_agree_with_the_kernel(spark, body):
    import random

    rng = random.Random(len(body))
    texts = ["".join(rng.choice(["b", "a", "1", "23", "x ", "AB", "é", "e\u0301", "नमस्ते", "²", "ß", "中", "\u200d", "🙂", "\xa0", "\n", "\n", "%41", "$0", ""]) for _ in range(rng.randint(0, 30))) + rng.choice(["\n", "\n", "\n", ""]) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    for window in (None, 6):
        g = Grammar.compile("define nl /\\r?\\n/\ngrammar input:\n" + body, search_window=window)
        assert linewise.line_rules(g)
        got, want = (sorted(map(str, rows.collect())) for rows in (linewise.nodes(df, g, ["k"], lower="always"), parse.nodes(df, g, ["k"])))
        assert got == want
        assert got == sorted(map(str, linewise.nodes(df, g, ["k"]).collect()))


def test_one_tree_at_a_time_and_small_nodes(spark, monkeypatch):
    """A batch of many documents takes hardly more memory than one of them."""
    docs = spark.createDataFrame([(1, "x")], "k int, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    g = Grammar.compile("grammar input:\n    match /\\d+/ /\\n/:\n        out.add('part?id=\"$0\"', 'x')\n")
    run = parse.nodes(docs, g, ["k"], columns=("depth",))
    n = 60_000
    text = "".join(f"{i}\n" for i in range(n))

    def peak(copies):
        batch = pa.RecordBatch.from_arrays([pa.array(range(copies), pa.int32()), pa.array([text] * copies)], names=["k", "__text"])
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in run(iter([batch]))) == copies * (n + 1)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    one = peak(1)
    assert one < 350 * n
    assert peak(3) < 1.2 * one


def test_outputs_leave_in_batches_of_bounded_size(spark, monkeypatch):
    made = []
    monkeypatch.setattr(parse.F, "arrow_udf", lambda ddl: lambda f: made.append(f) or (lambda column: None))
    monkeypatch.setattr(parse, "BATCH_CHARS", 1000)
    g = Grammar.compile("grammar input:\n    match /\\d+/ /\\n/:\n        out.create('e', '$0')\n")
    parse.parse_column(g, "text", "xml", columns=("execution", "consumed"))
    texts = ["1\n" * 9, None, "", "2\n"] * 8
    got = list(made[0](iter([pa.array(texts)])))
    assert len(got) > 4
    rows = [r for a in got for r in a.to_pylist()]
    assert [r and r["consumed"] for r in rows] == [t if t is None else len(t) for t in texts]
    assert all(r is None or r["execution"].startswith("<?xml") for r in rows)


def test_table_function_takes_pickled_rows(spark):
    """Arrow's tables of single rows take several times as long."""
    sql.register_table_function(spark, "some_nodes", Grammar.compile(LINES))
    got = spark.sql("SELECT k, n.node_id, n.attrs, n.text FROM VALUES (1, 'Ab c\n\nd\n'), (2, NULL), (3, '') d(k, t), LATERAL some_nodes(t) n")
    assert "ArrowEvalPythonUDTF" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.k, r.node_id, [(a.key, a.value) for a in r.attrs], r.text) for r in got.collect())
    assert rows == [(1, 0, [], None), (1, 1, [("first", "Ab")], "Ab c"), (1, 2, [], None), (1, 3, [], "d"), (3, 0, [], None)]


def test_whole_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    sizes = []
    read = catalogue.read_texts
    monkeypatch.setattr(catalogue, "read_texts", lambda *a: sizes.extend(r.text.count("\n") for r in read(*a).collect()) or read(*a))
    monkeypatch.setattr(catalogue, "FILE_LINES", 30)
    spark.range(100).selectExpr("id AS event_id", "if(id % 3 = 0, 'a', 'b') AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.id, r.value) for r in catalogue.whole_files(spark, str(tmp_path)).collect()}
    assert got == {(i, "b" if i % 3 else "a") for i in range(100)}
    assert sum(sizes) == 100 and max(sizes) <= 30


def test_texts_move_once_for_all_skips(spark, tmp_path):
    spark.createDataFrame([(1, "a. b\n")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue_language.skip_kinds(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate") < plan.find("Exchange hashpartitioning")  # the exchange is below
