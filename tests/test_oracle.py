"""Spark queries against their DuckDB restatements on the smallest tables.

Every registered query with oracle SQL is compared (row count, column names,
order-insensitive values); the full run at sf0.01 is tools/check_oracle.py.
"""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from readaloud.plans import registry
from readaloud.sources.tables import TABLES

QUERIES = registry.queries()
SQL = registry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = df.collect()
    res = con.execute(SQL[name])
    dcols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in got]) == _rows(dcols, res.fetchall())


def test_every_query_has_oracle_or_is_rows_only():
    assert set(SQL) <= set(QUERIES) <= set(E.queries())
    assert set(QUERIES) == set(SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["content_id", "chunk_index", "model", "voice_requested", "voice_effective", "input",
                          "n_chars", "n_words", "est_seconds", "start_offset"]
    assert df.count() > 0
