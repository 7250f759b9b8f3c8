import duckdb
import pytest

from conftest import SF_SMALL
from readaloud.llm import queries as Q
from readaloud.sources.tables import TABLES
from test_oracle import _rows


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF_SMALL)
    res = con.execute(Q.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, res.fetchall())
