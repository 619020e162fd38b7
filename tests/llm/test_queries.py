"""Every training-data query over the smallest tables, against its SQL or what must hold of it."""

import pytest

from orebody.llm import queries
from orebody.sources.readers import table
from tests.test_entry import DATA, comparable, duck, pytestmark  # noqa: F401

MUST = {
    "p1_sample": lambda spark, got: len(got) == min(150, table(spark, DATA, "tweet").where("size(hashtags) > 0").count()),
    "p7_found": lambda spark, got: all(r.business_id_1 < r.business_id_2 for r in got),
    "p7_locations": lambda spark, got: sum(1 / r.n for r in got) == pytest.approx(len({r.location for r in got})),
    "p8_ids": lambda spark, got: len(got) == table(spark, DATA, "documents").count(),
    "p9_near": lambda spark, got: {tuple(r) for r in queries.p9_found(spark, DATA).collect()} <= {tuple(r) for r in got},
    "p10_found": lambda spark, got: len(got) == len({tuple(r) for r in got}) > 0,
    "p10_segments": lambda spark, got: all(r.start < r.end and 0 <= r.confidence <= 1.0001 for r in got),
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    got = df.collect()
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert comparable(got, df.columns) == comparable(want.fetchall(), want.columns)
    else:
        assert MUST[name](spark, got)
