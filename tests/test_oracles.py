"""Each registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert ours
        return
    rows = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert ours == sorted(repr(tuple(map(plain, r))) for r in rows)
