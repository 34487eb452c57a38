"""Every analytics query that has SQL, against DuckDB on the same tables; the others give rows."""

import duckdb
import pytest

from voicegrain import queries_advice as Q

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"]


def rows(frame_rows, cols):
    def plain(x):
        return f"{x:.4f}".replace("-0.0000", "0.0000") if isinstance(x, float) else str(x)

    return sorted(tuple(plain(v) for v in r) for r in frame_rows)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, sf, con, name):
    got, want = Q.QUERIES[name](spark, sf), con.sql(Q.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert rows([[r[c] for c in cols] for r in got.collect()], cols) == rows([[r[i] for i in at] for r in want.fetchall()], cols)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_gives_rows(spark, sf, name):
    got = Q.QUERIES[name](spark, sf)
    assert got.columns and (got.count() > 0 or name == "cmp_07_trust_impact")  # no alerts differ on the shared tables
