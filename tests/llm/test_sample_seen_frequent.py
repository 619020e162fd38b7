"""Sample, membership and frequent items."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orebody.llm.iceberg import frequent_items
from orebody.llm.reservoir import GeometricFile, fixed_size_sample, population_draw
from orebody.llm.seen import EliasFano, _pieces, digested, first_arrivals, seen_before, wrong_answer_rate
from tests.conftest import tuples


@pytest.mark.parametrize(("capacity", "buffer"), [(40, 10), (30, 30), (5, 1), (64, 16)])
def test_every_record_is_equally_likely(tmp_path, capacity, buffer):
    counts, runs, n = np.zeros(300), 1200, 300
    for seed in range(runs):
        file = GeometricFile(capacity, np.random.default_rng(seed), str(tmp_path), buffer=buffer)
        for start in range(0, n, 41):
            size = min(41, n - start)
            for i in file.accept(size):
                file.insert(start + int(i))
        sample = file.sample()
        assert len(sample) == len(set(sample)) == capacity
        counts[sample] += 1
    p = capacity / n
    z = (counts - runs * p) / np.sqrt(runs * p * (1 - p))
    assert abs(z).max() < 5 and 0.85 < z.std() < 1.15
    assert abs(counts[:100].sum() - counts[-100:].sum()) < 6 * np.sqrt(200 * runs * p * (1 - p))


def test_population_draw():
    rng = np.random.default_rng(0)
    total = np.sum([population_draw([10, 30, 0, 60], 20, rng) for _ in range(3000)], axis=0)
    assert total[2] == 0 and abs(total / 3000 - [2, 6, 0, 12]).max() < 0.15
    assert sum(population_draw([10**30, 10**31], 50, rng)) == 50
    assert population_draw([2, 1], 9, rng) == [2, 1]


def test_sample_of_a_table(spark, rows):
    df = spark.range(5000).repartition(9).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.array(F.struct(F.lit("x").alias("text")))).alias("tags"), F.lit(1).alias("_shard"))
    got = fixed_size_sample(df, 150, fan_in=3)
    assert got.columns == df.columns
    sample = got.collect()
    assert len({r.id for r in sample}) == len(sample) == 150
    assert {r.id for r in sample} == {r.id for r in got.collect()}
    hits = Counter(int(r.id) // 1000 for seed in range(12) for r in fixed_size_sample(df, 150, seed=seed).select("id").collect())
    assert all(abs(hits[k] - 360) < 5 * (1800 * 0.2 * 0.8) ** 0.5 for k in range(5))
    assert fixed_size_sample(df.limit(20), 150).count() == 20
    assert fixed_size_sample(df.where("id < 0"), 150).count() == 0
    same = rows([("a",)] * 10, "x string")
    assert fixed_size_sample(same, 4).count() == 4
    with pytest.raises(ValueError):
        fixed_size_sample(df, 0)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=200), st.lists(st.integers(0, 2**40 - 1), min_size=1, max_size=50))
def test_elias_fano(values, probes):
    sorted_values = np.array(sorted(values), np.uint64)
    code = EliasFano(sorted_values, 40)
    assert code.values().tolist() == sorted(values)
    ways = [code.successor] + [code._sampled_successor, code._decoded_successor] * bool(values)
    for way in ways:
        value, found = way(np.array(probes, np.uint64))
        for p, v, f in zip(probes, value.tolist(), found.tolist()):
            above = [x for x in values if x >= p]
            assert f == bool(above) and (not f or v == min(above))
    fresh = np.array(sorted(set(probes) - values), np.uint64)
    assert code.merged(fresh).values().tolist() == sorted(values | set(probes))


def test_elias_fano_is_small():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 20000, dtype=np.uint64))
    code = EliasFano(values, 56)
    assert code.size_in_bytes * 8 / len(values) < 2.1 + 56 - np.log2(len(values)) + 1
    assert code.contains(values).all() and not code.contains(values + np.uint64(1)).all()
    few = np.concatenate([values[::700], values[::700] + np.uint64(3), [np.uint64(0), np.uint64((1 << 56) - 1)]])  # by sampled places
    assert (code.contains(few) == np.isin(few, values)).all()


def test_pieces_grow_with_the_stream(spark):
    """Ten times as long a stream has a fixed number of pieces more, whatever the order numbers are."""
    many = []
    for n in (10_000, 100_000):
        df = spark.range(n).select((F.col("id") * 1000 - 7).alias("seq"))
        number, _ = _pieces(df, "seq", 500, 1.25)
        got = df.select("seq", number.alias("p")).groupBy("p").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n")).orderBy("p").collect()
        assert all(x.b < y.a for x, y in zip(got, got[1:])) and abs(got[0].n - 500) <= 2
        assert all(y.n <= 1.26 * x.n + 2 for x, y in zip(got, got[1:]))
        many.append(len(got))
    assert many[1] - many[0] < 12


def test_seen_before_equals_a_set(rows):
    rng = random.Random(3)
    keys = ["a", "A", " a", "Ü", "", "  ", None, *(f"k{i}" for i in range(60))]
    stream = [(i, "hot" if rng.random() < 0.4 else rng.choice(keys), "x") for i in range(1, 900)]
    history = [("k1",), ("k2",), (None,), ("",), ("k1",)]
    known, want = {"k1", "k2"}, []
    for seq, key, _ in stream:
        if key and key.strip():
            want.append((seq, key in known))
            known.add(key)
    rng.shuffle(stream)
    df, old = rows(stream, "seq bigint, city string, seen string"), rows(history, "city string")
    for piece in (1 << 17, 100, 7):
        assert tuples(seen_before(df, old, key="city", order="seq", piece=piece)) == sorted(want, key=repr)
    assert tuples(seen_before(df, rows([], "c string"), key="city", order="seq", history_key="c").where("not seen")) != []
    assert seen_before(df.where("false"), old, key="city", order="seq").count() == 0
    assert first_arrivals(rows([(5, "q"), (5, "q"), (None, "q")], "seq bigint, city string"), old, key="city", order="seq").count() == 1


def test_wrong_answer_rate(spark, rows):
    df = spark.range(3000).select(F.col("id").alias("seq"), F.concat(F.lit("c"), F.col("id")).alias("city"))
    old = rows([], "city string")
    exact = wrong_answer_rate(df, old, key="city", order="seq").first()
    assert (exact.records, exact.seen, exact.wrong) == (3000, 0, 0)
    coarse = wrong_answer_rate(df, old, key="city", order="seq", bits=14).first()
    assert coarse.wrong > 0 and coarse.wrong_rate <= coarse.expected_rate_of_new_keys
    digest = wrong_answer_rate(df, old, key="city", order="seq", bits=12, hashed=digested).first()
    keys = [hashlib.md5(f"c{k}".encode()).hexdigest()[:3] for k in range(3000)]
    assert digest.wrong == 3000 - len(set(keys)) > 0


def test_frequent_items(rows):
    rng = random.Random(8)
    values = [None if (z := rng.paretovariate(0.6)) > 1e9 else f"t{int(z)}" for _ in range(4000)] + [None] * 50 + [""] * 60
    n = Counter(values)
    want = sorted([(v, c) for v, c in n.items() if v is not None and c * 100 >= len(values)], key=repr)
    df = rows([(v, 1) for v in values], "tag string, n int")
    for hashes, buckets in ((4, 8192), (1, 100), (2, 128)):
        assert tuples(frequent_items(df, "tag", 100, hashes=hashes, buckets=buckets).select("tag", "n")) == want
    assert frequent_items(df.where("false"), "tag", 100).count() == 0
    assert tuples(frequent_items(rows([("a",), ("b",)], "tag string"), "tag", 2).select("tag")) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        frequent_items(df, "tag", 0)
