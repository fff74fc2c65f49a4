"""Every registered query of the code graph against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from codequarry.registry import ORACLES, QUERIES

DIR = os.environ.get("CODEQUARRY_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
