"""Times the headline queries and prints one line of JSON.

``value`` is the sum of ``queries``.  Beside it: one text of 8 MB from its
grammar's source to JSON on the driver, with compilation; a corpus of 32 MB to
JSON; the corpus operators, each for itself.
"""

from __future__ import annotations

import json
import os
import resource
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Of the catalogue; single texts of the shapes of published workloads come on top.
HEADLINE = (
    "linesplit_nodes", "linesplit_counts", "csv_columns", "user_records_attrs", "kv_path_attributes", "add_append_text", "create_vs_add_cardinality",
    "enter_reuse", "alternation_first_match", "when_lookahead", "skip_comments", "trigger_before", "consumed_bytes", "json_escape", "xml_escape", "html_links", "transcript_turns",
)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sections(n_bytes: int, seed: int = 0) -> tuple[str, str]:
    """A grammar of sections with entries and attributes, and a text of that shape."""
    import random

    rng = random.Random(seed)
    grammar = ["define nl /\\n/", "define tok /[^ \\n]+/", "define rest /[^\\n]*/"]
    calls = []
    for s in range(10):
        for g in range(3):
            grammar += [f"grammar e{s}_{g}:", f"    match '  f' /\\d/ ' ' rest nl:\n        out.add('f$1', '$3')"]
        grammar.append(f"grammar s{s}:")
        for g in range(3):
            grammar.append(f"    match ' g{g} ' tok nl:\n        out.open('g{g}?name=\"$1\"')\n        e{s}_{g}()")
        calls.append(f"    match 'sect{s}' nl:\n        out.open('sect{s}')\n        s{s}()\n")
    grammar += ["grammar input:", *calls, "    skip /!\\n/"]
    out, size = [], 0
    while size < n_bytes:
        part = [f"sect{rng.randrange(10)}\n"]
        for _ in range(rng.randint(3, 9)):
            part.append(f" g{rng.randrange(3)} inst-{rng.randrange(10**6):06d}\n")
            part += [f"  f{k} value-{rng.randrange(10**6)} of {rng.randrange(100)}\n" for k in range(3)]
        part.append("!\n")
        out += part
        size += sum(map(len, part))
    return "\n".join(grammar) + "\n", "".join(out)


def main() -> None:
    from pyspark.sql import functions as F

    from sylvan import catalogue
    from sylvan.functions.writers import write_tree
    from sylvan.operators import parse
    from sylvan.plans.grammar import Grammar

    began = time.time()
    spark = session()
    start_up = time.time() - began
    queries = catalogue.queries()
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(queries["linesplit_nodes"](spark, SF_DIR))  # the Python workers start here
    took: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        noop(queries[name](spark, SF_DIR))
        took[name] = round(time.time() - t, 3)
    grammar, text = sections(8_000_000)
    t = time.time()
    g = Grammar.compile(grammar)
    run = g.machine().run(text)
    assert run.error is None, run.error
    output = write_tree(run.tree.root, "json")
    one = time.time() - t
    big, n_out = len(text), len(output)
    del run, output
    grammar, text = sections(1_000_000)
    g = Grammar.compile(grammar)
    docs = spark.range(0, 32, 1, 32).withColumn("text", F.lit(text))
    t = time.time()
    noop(parse.parse(docs, g, fmt="json"))
    many = time.time() - t
    took["sections_32_mb"] = round(many, 3)
    corpus: dict[str, float] = {}
    try:  # the corpus operators can be taken out of the repository
        from sylvan.llm import queries as corpus_queries
    except ImportError:
        corpus_queries = None
    for name, query in corpus_queries.queries().items() if corpus_queries else ():
        t = time.time()
        noop(query(spark, SF_DIR))
        corpus[name] = round(time.time() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1],
        "start_up_sec": round(start_up, 3), "one_text_to_json_mb_per_sec": round(big / 1e6 / one, 2), "one_text_json_mb": round(n_out / 1e6, 1), "corpus_to_json_mb_per_sec": round(32 * len(text) / 1e6 / many, 2),
        "peak_driver_python_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, "peak_python_worker_mb": resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss // 1024,
        "corpus_queries": corpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
