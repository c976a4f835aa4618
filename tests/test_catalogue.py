"""Every registered query with SQL against DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tellurion.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    r = duck.sql(catalogue.ORACLE_SQL[name])
    at = [list(r.columns).index(c) for c in cols]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
