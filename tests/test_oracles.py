"""Every query against its DuckDB text on the smallest tables."""

import math

import duckdb
import pytest

from scoregrid.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events documents embeddings pages".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v):.5f}"

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
