"""The driver's contract, and every core query against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from orebody.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def comparable(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return sorted(([fix(r[k]) for k in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns == ["state", "stars"]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert comparable(got, df.columns) == comparable(want.fetchall(), want.columns)
