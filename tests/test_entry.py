import math

import duckdb
import pytest

import __spark_entry__ as entry
from pairlight import queries as Q


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if not isinstance(v, str) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("lineitem", "customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.QUERIES[name](spark, sf)
    want = con.sql(Q.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    theirs = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(_plain(r[c]) for c in cols) for r in theirs), key=str)
