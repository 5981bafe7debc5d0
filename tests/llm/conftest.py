import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, score string, id string, key string, sequence_id string"


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice(["th", "an", "er", "on", "re", "st", "ou", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) if n else ""


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows, copies and near copies,
    rare characters; with columns whose names clash with those of results."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", "   ", "one", "one two", base, base, near, base.upper(), prose(rng, 30_000), "x" * 300_000, "\n".join(["same line"] * 30), "中文字符 " * 40, "İẞ  a\x00b \x1c", "a b c d e f " * 50]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(25)]
    rows = [(i, t, "en", "src0", None if t is None else len(t), "mine", "mine", "mine", "mine", "mine") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "a null id with some words in it", "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('edges')}/t"
    spark.createDataFrame(edge_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
