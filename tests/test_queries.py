"""Every registered query that has a DuckDB counterpart gives its rows."""

import duckdb
import pytest

from loamwork import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return round(float(v), 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = sorted([tuple(_plain(r[c]) for c in order) for r in df.collect()])
    at = [want.columns.index(c) for c in order]
    assert rows == sorted([tuple(_plain(r[i]) for i in at) for r in want.fetchall()])


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("texts", [["", None, "a\rb"], ["", None, "a\nb", "a\0\nb"]])
def test_odd_texts_as_delimited_text(spark, tmp_path, texts):
    rows = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in texts for s in ("web", "", None))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    sql = queries.oracle_sql()["csv_multiline_split"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.queries()["csv_multiline_split"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(duckdb.sql(sql).fetchall(), key=repr)
