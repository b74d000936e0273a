"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from lathe import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return sorted(map(tuple, frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, tiny, duck, name):
    got, want = queries.QUERIES[name](spark, tiny).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    assert queries.QUERIES[name](spark, tiny).count() >= 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["id", "count", "doc_id"] and frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
