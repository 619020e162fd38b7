"""Hot keys are dealt out, and nothing is lost or doubled by it."""

from pyspark.sql import functions as F

from orebody.functions import skew
from orebody.operators import graph, itemsets, recommend, similarity
from tests.conftest import tuples


def test_split_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("a"))
    right = spark.range(40).select(F.when(F.col("id") < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("b"))
    got = skew.split_join(left, right, ["k"], ["a"], least=100)
    assert got.columns == ["k", "a", "b"]
    assert tuples(got) == tuples(left.join(right, "k"))
    dealt = left.where("k = 'hot'").select(skew.salt_of(skew.hot_buckets(left, "k", least=100), ["k"], ["a"]).alias("s")).groupBy("s").count().collect()
    assert len(dealt) == 64 and max(r["count"] for r in dealt) < 80


def results(spark):
    rows = spark.range(300).select((F.col("id") % 40).cast("string").alias("u"), F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise((F.col("id") * 7 % 23).cast("string")).alias("b"), (1 + F.col("id") % 5).cast("double").alias("r"))
    ratings = recommend.one_rating_per_pair(rows, "u", "b", "r")
    return [
        tuples(recommend.pearson_pairs(ratings, of="item", over="user")), tuples(similarity.similar_pairs(rows, record="b", token="u", threshold=0.3)),
        tuples(itemsets.frequent_itemsets(itemsets.baskets(rows, 1, "u", "b"), 4, max_size=2)), tuples(graph.shared_group_edges(rows, vertex="b", group="u", min_shared=2, min_ratio=0.5)),
    ]


def test_operators_with_every_key_hot(spark, monkeypatch):
    plain = results(spark)
    assert all(plain)
    monkeypatch.setattr(skew, "hot_buckets", lambda *a, **k: list(range(4096)))
    assert results(spark) == plain


def test_candidates_hold_every_frequent_set(spark):
    rows = spark.range(240).select((F.col("id") % 40).alias("basket"), F.floor(F.col("id") * 11 / 7 % 4).alias("item"))
    found = {(r.k, tuple(r.itemset)) for r in itemsets.frequent_itemsets(rows, 20).collect()}
    assert found and found <= {(r.k, tuple(r.itemset)) for r in itemsets.son_candidates(rows, 20).collect()}
