"""Every query with oracle SQL gives the same rows in DuckDB, at the smallest scale."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
TABLES = "conversations events documents"

from tidewheel.plans.registry import ORACLES, QUERIES  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 5)
    return v


def rows(found, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    got = con.execute(ORACLES[name])
    cols = [c[0] for c in got.description]
    want = rows(got.fetchall(), cols)
    assert sorted(df.columns) == sorted(cols)
    assert rows([[r[c] for c in cols] for r in df.collect()], cols) == want
    assert want


def test_all_queries_have_oracles():
    assert set(QUERIES) == set(ORACLES)
