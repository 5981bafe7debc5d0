import os

import pytest

from sylvan import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    df = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(repr(tuple(int(v) if hasattr(v, "item") else v for v in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def test_window_chunks_cover_all_documents(spark, duck):
    """Against a cutter of UTF-8 bytes, over all documents and characters of two to four bytes at the cuts."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}

    def cuts(text):
        data, a, i = text.replace("\n", " ").encode(), 0, 0
        while a < len(data):
            b = a + 1000
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            yield i, data[a:b].decode()
            a, i = b, i + 1

    got = {(r.k, r.ord, r.line) for r in catalogue.queries()["linesplit_window_bytes"](spark, DATA).collect()}
    assert got == {(k, *x) for k, t in texts.items() for x in cuts(t or "")}
    assert {k for k, _, _ in got} == {k for k, t in texts.items() if t} and any(not t.isascii() for t in texts.values() if t)


def test_window_chunks_at_wide_characters(spark, tmp_path):
    import duckdb

    texts = [(i * 4 + j, "x" * j + c * 1200) for i, c in enumerate(["é", "中", "𝄞"]) for j in range(4)] + [(90, ""), (91, None), (92, "a\nb")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "linesplit_window_bytes"
    got = rows(catalogue.queries()[name](spark, str(tmp_path)).toPandas())
    assert got == rows(con.sql(catalogue.oracle_sql()[name]).df()) and len(got[1]) > 30
