"""Every plan against its SQL in DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from textloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_plan(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    rows = df.collect()
    if name not in plans.oracles():
        assert rows
        return
    want = duck.execute(plans.oracles()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(str([plain(r[c]) for c in order]) for r in rows)
    assert got == sorted(str([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
