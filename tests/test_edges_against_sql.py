"""Queries against their DuckDB text on small tables of our own, made of the cases in which the given tables are poor."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from scoregrid.queries import ORACLES, QUERIES

START = dt.datetime(2024, 1, 1)


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its text) on the given Arrow tables, sorted, with equal column order."""
    duck = duckdb.connect()
    for t, table in tables.items():
        pq.write_table(table, f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, want = QUERIES[name](spark, str(folder)), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = lambda rows, names: sorted(tuple(r[names.index(c)] for c in columns) for r in rows)
    return order([tuple(r) for r in df.collect()], df.columns), order(want.fetchall(), want.columns)


def events(*rows):
    """(event_id, seconds after the start, user_id, event_type, value)"""
    names = ("event_id", "ts", "user_id", "event_type", "value")
    fixed = [(i, START + dt.timedelta(seconds=s), u, t, float(v)) for i, s, u, t, v in rows]
    return pa.table(dict(zip(names, map(list, zip(*fixed, strict=True)), strict=True)))


def test_newest_snapshot_has_all_elements_of_the_block(spark, tmp_path):
    """Two elements share the newest block; in one of them an id of over a million, a block earlier, outranks the newest."""
    got, want = both(spark, tmp_path, "newest_snapshot", events=events((1, 0, 3, "view", 10), (2, 1200, 4, "view", 10), (3, 1201, 5, "click", 10), (4, 600, 6, "error", 10), (2_500_000, 1190, 7, "click", 10)))
    assert got == want
    assert len(got) == 2


def test_scores_at_the_bound_agree(spark, tmp_path):
    """Event 11 scores 0 and has a latency of 40 / 200: a difference of exactly 1 - 0.8."""
    got, want = both(spark, tmp_path, "score_agreement", events=events((11, 0, 3, "view", 20), (22, 0, 3, "view", 20.01), (1, 5, 3, "view", 20), (2, 5, 4, "click", 0)))
    assert got == want
    assert (True, 0.0, 11) in got and (False, 0.0, 22) in got
