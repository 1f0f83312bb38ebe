"""Every query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _told(v):
    return f"{v:.12g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, other = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(other.columns)
    at = [other.columns.index(c) for c in cols]
    assert sorted([_told(r[c]) for c in cols] for r in df.collect()) == sorted([_told(r[i]) for i in at] for r in other.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
