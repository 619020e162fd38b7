"""Plans: columns are pruned and filters pushed down at the scan, rows combined before the shuffle."""

import os
import re

import pytest

from orebody.operators import explore
from orebody.plans import core, spatial
from orebody.sources.readers import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def read_columns(text):
    return [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<(.*?)>\n", text)]


def test_columns_are_pruned(spark, capsys):
    assert read_columns(plan(core.user_totals(spark, DATA), capsys)) == [{"user_id", "review_count"}]
    assert read_columns(plan(core.sentiment_score(spark, DATA), capsys)) == [{"doc_id", "text", "source"}]
    for columns in read_columns(plan(spatial.p6_found(spark, DATA), capsys)):
        assert columns == {"business_id", "latitude", "longitude"}
    tables = read_columns(plan(core.state_avg(spark, DATA), capsys))
    assert {"business_id", "state", "loaded_at"} in tables and len(tables) == 2


def test_filters_reach_the_scan(spark, capsys):
    text = plan(core.sentiment_score(spark, DATA), capsys)
    assert "EqualTo(source,tip)" in text
    assert "IsNotNull(review_id)" in plan(core.left_join_dedup(spark, DATA), capsys)


def test_groups_combine_before_the_shuffle(spark, capsys):
    text = plan(explore.top_groups(table(spark, DATA, "users"), "name"), capsys)
    assert "partial_count" in text and "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["user_totals", "state_avg", "user_means", "clamp_ratings", "jaccard_exact", "sentiment_score", "top_names", "pearson_items"])
def test_no_python_in_the_plan(spark, capsys, name):
    text = plan(core.QUERIES[name](spark, DATA), capsys)
    assert not re.search("Python|Pandas|InArrow|CartesianProduct", text)
