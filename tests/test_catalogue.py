"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from gridseek.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, data, name):
    df = catalogue.QUERIES[name](spark, data)
    ours = df.collect()
    theirs = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(df.columns)
    key = sorted(columns)
    want = sorted(repr([plain(dict(zip(columns, r))[c]) for c in key]) for r in theirs.fetchall())
    got = sorted(repr([plain(r[c]) for c in key]) for r in ours)
    if got != want:  # numbers may differ in type only
        assert [x.replace(".0,", ",").replace(".0]", "]") for x in got] == [x.replace(".0,", ",").replace(".0]", "]") for x in want]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0
