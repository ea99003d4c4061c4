"""Every query runs; those with SQL give DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(q for q in entry.queries() if not q.startswith("op") and q != "pipeline")


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    names = sorted(df.columns)
    rows = sorted(([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in names]).collect()), key=str)
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == names
        assert rows == sorted(([plain(x) for x in r] for r in want.select(*[f'"{c}"' for c in names]).fetchall()), key=str)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
