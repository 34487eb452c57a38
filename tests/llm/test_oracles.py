"""Every query of the subpackage that has SQL, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from voicegrain.llm import queries as Q

TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "embeddings"]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, sf)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert a == b
    assert os.path.exists(sf)
