"""Every registered query with SQL gives the rows DuckDB gives, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(clean, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    got, expected = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    for a, b in zip(rows(got), rows(expected)):
        for x, y in zip(a, b):
            assert x == y or pytest.approx(y, rel=1e-6, abs=1e-6) == x


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
