"""Every query against its SQL in DuckDB, on the smallest test data."""

from __future__ import annotations

import os

import duckdb
import pytest

from storyloom.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows_of(frame):
    """Rows as texts, columns by name, numbers alike whatever their type."""

    def plain(x):
        if x is None or x != x:
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 9) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
