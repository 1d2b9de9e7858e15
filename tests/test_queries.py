"""Every registered query of the reporting engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from tallyspark.plans import etl_queries, panel_queries, store_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES = panel_queries.queries() | text_queries.queries() | etl_queries.queries() | store_queries.queries()
SQL = panel_queries.oracle_sql() | text_queries.oracle_sql() | etl_queries.oracle_sql() | store_queries.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    if name not in SQL:
        assert got
        return
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())
