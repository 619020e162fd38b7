"""Small cases with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from orebody.functions.hashing import HASH_TABLE, bytes_mod, byte_values, string_hashes, trailing_zeros
from orebody.operators import explore, graph, itemsets, metrics, recommend, similarity, sketches
from tests.conftest import tuples

STATES = "NV AZ ON NC OH PA QC AB WI IL SC NV NY AZ TX CA FL WA VA GA MI XGM CON AL UT".split()


def test_hash_codes(rows):
    got = rows([("NV",)], "s string").select(string_hashes(F.col("s"), 200)[0], string_hashes(F.col("s"), 200)[1], string_hashes(F.col("s"), 200)[2], string_hashes(F.col("s"), 200)[3]).first()
    assert tuple(got) == (191, 137, 167, 155)
    assert rows([("NV",)], "s string").select(bytes_mod(byte_values(F.col("s")), 786433)).first()[0] == 20054


@pytest.mark.parametrize("word", ["", "a", "Montréal", "東京", "x" * 300])
def test_string_hash_equals_big_integer(rows, word):
    code = int.from_bytes(word.encode(), "big")
    got = rows([(word,)], "s string").select(string_hashes(F.col("s"), 200)).first()[0]
    assert got == [((a * code + b) % p) % 200 for a, b, p in HASH_TABLE]


def test_trailing_zeros(rows):
    df = rows([(0,), (128,), (12,), (7,)], "v bigint").select("v", trailing_zeros(F.col("v")).alias("z"))
    assert {r.v: r.z for r in df.collect()} == {0: 1, 128: 7, 12: 2, 7: 0}


def test_bloom(rows):
    df = rows([(s, i, i // 5) for i, s in enumerate(STATES)] + [(None, 99, 5)], "state string, seq int, batch int")
    last = sketches.bloom_error_rate(df, element="state", order="seq", batch="batch").orderBy(F.desc("batch")).first()
    assert (last.batch, last.fp, last.tn) == (5, 3, 20)
    assert last.fpr == pytest.approx(0.13043478260869565)
    empty = rows([], "state string, seq int, batch int")
    assert sketches.bloom_error_rate(empty, element="state", order="seq", batch="batch").count() == 0


@pytest.mark.parametrize(
    ("cities", "n", "estimate"),
    [(["Las Vegas", "Ajax", "Montréal"], 3, 8.333333333333334), (["Las Vegas", "Ajax", "Montréal", "Toronto", "Phoenix", "Charlotte", "Cleveland", "Pittsburgh", "Madison", "Urbana"], 10, 12.444444444444445)],
)
def test_flajolet_martin(rows, cities, n, estimate):
    df = rows([(c, "2024-01-01 00:00:05") for c in cities * 2] + [(None, "2024-01-01 00:00:05")], "city string, t string").withColumn("t", F.to_timestamp("t"))
    got = sketches.flajolet_martin(df, element="city", time="t", window="10 seconds", slide="10 seconds").collect()
    assert [(r.n_distinct, pytest.approx(r.estimate)) for r in got] == [(n, estimate)]


def test_betweenness_and_modularity(rows):
    path = rows([("a", "b"), ("b", "c"), ("c", "b"), ("a", "a")], "src string, dst string")
    assert tuples(graph.betweenness(path)) == [("a", "b", 2.0), ("b", "c", 2.0)]
    two = rows([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")], "src string, dst string")
    bridge = graph.betweenness(two).first()
    assert (bridge.src, bridge.dst, bridge.betweenness) == ("c", "d", 9.0)
    parts = rows([(v, "x" if v in "abc" else "y") for v in "abcdef"], "id string, community string")
    assert graph.modularity(two, parts).first()[0] == pytest.approx(2 * (3 / 7 - 1 / 4))
    removed, best = graph.girvan_newman(two)
    assert tuples(removed.where("round = 1").select("src", "dst")) == [("c", "d")]
    assert tuples(best) == [(v, "a" if v in "abc" else "d") for v in "abcdef"]
    empty = rows([], "src string, dst string")
    assert graph.betweenness(empty).count() == graph.components(empty).count() == 0
    assert graph.modularity(empty, rows([], "id string, community string")).first()[0] is None


def test_pearson_is_zero_where_undefined(rows):
    flat = rows([("u", "i", 1.0), ("v", "i", 1.0), ("u", "j", 2.0), ("v", "j", 3.0)], "user string, item string, rating double")
    got = {(r.a, r.b): r.w for r in recommend.pearson_pairs(flat, of="item", over="user", min_common=2).collect()}
    assert all(got.get(k, 0) == 0 for k in (("i", "j"), ("j", "i")))


def test_jaccard_and_cosine(rows):
    df = rows([("a", 1), ("a", 2), ("a", 3), ("a", 3), ("b", 2), ("b", 3), ("b", 4), ("c", 9), (None, 1), ("a", None)], "s string, t int")
    assert tuples(similarity.similar_pairs(df, record="s", token="t")) == [("a", "b", 0.5)]
    cosine = similarity.similar_pairs(df, record="s", token="t", measure="cosine", threshold=0.6).first()
    assert cosine.similarity == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        similarity.similar_pairs(df, record="s", token="t", measure="dice")


def test_itemsets(rows):
    df = rows([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "a"), (4, None), (None, "a")], "basket int, item string")
    found = itemsets.frequent_itemsets(df, 2)
    assert tuples(found.select(F.array_join("itemset", ","), "support")) == [("a", 3), ("a,b", 2), ("b", 2)]
    assert [tuple(r) for r in itemsets.itemset_report(found).collect()] == [(1, "('a'),('b')"), (2, "('a', 'b')")]
    trap = rows([(1, "1"), (1, "2"), (2, "12")], "basket int, item string")
    assert itemsets.frequent_itemsets(trap, 2).count() == 0
    kept = itemsets.longer_than(rows([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y")], "basket int, item string"), 2)
    assert {r.basket for r in kept.collect()} == {1}
    with pytest.raises(ValueError):
        itemsets.baskets(df, 3)


def test_error_report(rows):
    p = rows([(1, 1.0), (2, 2.0), (3, 2.5), (4, 5.0), (9, 1.0)], "k int, prediction double")
    t = rows([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (8, 1.0)], "k int, stars double")
    got = metrics.rating_error_report(p, t, ["k"]).first()
    assert tuple(got)[:5] == (1, 2, 0, 0, 1)
    assert got.rmse == pytest.approx(math.sqrt(19.25 / 4))
    pr = metrics.pair_precision_recall(rows([(1, 2), (1, 2), (3, 4)], "a int, b int"), rows([(1, 2), (5, 6)], "a int, b int"), ["a", "b"]).first()
    assert tuple(pr) == (2, 2, 0.5, 0.5)


def test_ties_and_clamp(rows):
    counts = rows([(f"t{i}", n) for i, n in enumerate((9, 8, 7, 6, 5, 5, 4))], "tag string, n int")
    assert explore.top_with_ties(counts, "tag", "n").count() == 6
    got = rows([(0.2,), (3.3,), (7.0,)], "x double").select(metrics.clamp(F.col("x"))).collect()
    assert [r[0] for r in got] == [1.0, 3.3, 5.0]


def test_dense_index_and_profile(rows):
    df = rows([(c,) for c in "zebra" * 3] + [(None,)], "c string")
    assert tuples(explore.dense_index(df, "c", "i")) == [("a", 0), ("b", 1), ("e", 2), ("r", 3), ("z", 4)]
    profile = explore.partition_profile(df.limit(2), 8).collect()
    assert len(profile) == 8 and sum(r.n_rows for r in profile) == 2


def test_default_and_dedup(rows):
    p = rows([("u", "i", 4.0)], "user string, item string, prediction double")
    keys = rows([("u", "i"), ("v", "j"), ("v", "j")], "user string, item string")
    assert tuples(recommend.with_default(p, keys)) == [("u", "i", 4.0), ("v", "j", 3.0)]
    first = explore.first_per_key(rows([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, o int, v string"), ["k"], ["o"])
    assert tuples(first.select("k", "v")) == [("a", "x"), ("b", "z")]
    assert explore.renamed(rows([(1, 2)], "` a` int, b int"), {" a": "x"}).columns == ["x"]


def test_sentiment(rows):
    df = rows([("the best, best!",), (None,), ("nothing",)], "t string").select(recommend.sentiment(F.col("t")))
    s = 2 * recommend.LEXICON["best"]
    assert [r[0] for r in df.collect()] == [pytest.approx(s / math.sqrt(s * s + 15)), 0.0, 0.0]


def test_opinion(rows):
    texts = ["nice", "delicious and perfect", "horrible", "rude, disappointing", "good", "not good", "wasn\u2019t very good", "the food was not what we call bad", "good!", "very good", None, "the chair"]
    got = dict(zip(texts, [r[0] for r in rows([(t,) for t in texts], "t string").select(recommend.opinion(F.col("t"))).collect()]))
    score = lambda s: pytest.approx(s / math.sqrt(s * s + 15))
    good = recommend.OPINIONS["good"]
    assert got["good"] == score(good) and got["not good"] == score(-0.74 * good)
    assert got["wasn\u2019t very good"] == score(-0.74 * (good + 0.3)) and got["very good"] == score(good + 0.3) and got["good!"] == score(good + 0.29)
    assert got["nice"] > 0 and got["delicious and perfect"] > got["nice"] and got["horrible"] < 0 and got["rude, disappointing"] < 0
    assert got["the food was not what we call bad"] < 0  # more than three words behind
    assert got[None] == got["the chair"] == 0


def test_newest_row_is_whole(rows):
    df = rows([("a", 1, "z", 9.0), ("a", 2, None, 3.0), ("a", 2, "b", None), ("b", None, "x", 1.0), ("b", 5, None, None), (None, 9, "n", 1.0), ("c", None, None, 2.0)], "k string, t int, name string, stars double")
    assert tuples(explore.newest_per_key(df, "k", "t", ["name", "stars"])) == [("a", "b", None), ("b", None, None), ("c", None, 2.0)]
    assert explore.newest_per_key(df.where("false"), "k", "t", ["name"]).count() == 0


def test_regression_hears_negation(rows, spark, tmp_path):
    from orebody.plans import core

    rows([("u", "n", 9, "2015", 1, 1, 1, 1, 4.0)], "user_id string, name string, review_count long, yelping_since string, useful long, funny long, cool long, fans long, average_stars double").write.parquet(f"{tmp_path}/users.parquet")
    rows([("i", "NV", 4.0, 9, 1.0, 1.0, None)], "business_id string, state string, stars double, review_count long, latitude double, longitude double, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/business.parquet")
    rows([(1, "tip", "not good", "u", "i", None)], "doc_id long, source string, text string, user_id string, business_id string, review_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = core._features(spark, str(tmp_path), rows([("u", "i", 4.0)], "user string, item string, rating double")).first()
    assert got.sentiment < 0
