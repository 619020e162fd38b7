"""Streams give what their batch forms give; files come back as written."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orebody.operators import graph, sketches
from orebody.sources import readers, sinks
from orebody.streaming import reservoir
from orebody.streaming import sketches as streams
from tests.conftest import tuples

WORDS = "NV AZ ON NC OH PA QC AB WI IL SC NV NY AZ TX CA FL WA VA GA MI XGM CON AL UT".split()


@pytest.fixture
def pieces(spark, tmp_path):
    schema = "seq bigint, state string, t timestamp"
    for k in range(5):
        part = [(i, WORDS[i], datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(5 * k, 5 * k + 5)]
        spark.createDataFrame([*part, (100 + k, None, datetime(2024, 1, 1))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return readers.parquet_stream(spark, str(tmp_path / "in"), schema), spark.read.parquet(str(tmp_path / "in")), schema


def test_bloom_stream(spark, tmp_path, pieces):
    stream, whole, _ = pieces
    streams.bloom_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), element="state", order="seq").awaitTermination(120)
    last = streams.bloom_rates(spark, str(tmp_path / "state")).orderBy(F.desc("batch")).first()
    batch = sketches.bloom_error_rate(whole.withColumn("b", F.lit(0)), element="state", order="seq", batch="b").first()
    assert (last.fp, last.tn) == (batch.fp, batch.tn) == (3, 20)


def test_fm_stream(spark, tmp_path, pieces):
    stream, whole, _ = pieces
    form = {"element": "state", "time": "t", "window": "6 hours", "slide": "2 hours"}
    out = streams.flajolet_martin_stream(stream, **form, late="0 seconds")
    out.writeStream.outputMode("complete").format("memory").queryName("fm").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert tuples(spark.table("fm")) == tuples(sketches.flajolet_martin(whole, **form))


def test_reservoir_stream(spark, tmp_path, pieces):
    stream, whole, schema = pieces
    streams.reservoir_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), key="seq", size=7).awaitTermination(120)
    assert tuples(streams.reservoir_rows(spark, str(tmp_path / "state"), schema)) == tuples(sketches.hashed_sample(whole, "seq", 7))


def test_bloom_stream_goes_on_after_a_restart(spark, tmp_path, pieces):
    """The second start sees only the new files, the counts go on, and each batch has its time."""
    stream, _, schema = pieces
    form = {"element": "state", "order": "seq"}
    streams.bloom_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), **form).awaitTermination(120)
    spark.createDataFrame([(200 + k, f"new{k}", datetime(2024, 2, 1)) for k in range(9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.bloom_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), **form).awaitTermination(120)
    whole = spark.read.parquet(str(tmp_path / "in")).withColumn("b", F.lit(0))
    last = streams.bloom_rates(spark, str(tmp_path / "state")).orderBy(F.desc("batch")).first()
    batch = sketches.bloom_error_rate(whole, element="state", order="seq", batch="b").first()
    assert (last.fp, last.tn) == (batch.fp, batch.tn) and last.time is not None
    assert spark.read.parquet(str(tmp_path / "state" / "bits")).count() <= 200
    sinks.write_timed(streams.bloom_rates(spark, str(tmp_path / "state")), "time", {"fpr": "FPR"}, str(tmp_path / "t.csv"))
    assert next((tmp_path / "t.csv").glob("*.csv")).read_text().startswith("Time,FPR\n20")


def test_algorithm_r_goes_on_after_a_restart(spark, tmp_path):
    """The reservoir fills, keeps its size, and the counts are those of the records in it."""
    schema = "id bigint, tags array<string>"

    def add(ids):
        spark.createDataFrame([*((i, [f"t{i % 4}", f"x{i}"]) for i in ids), (None, ["no"]), (-1, []), (-2, None), (-3, [None])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = readers.parquet_stream(spark, str(tmp_path / "in"), schema)
        counts = reservoir.reservoir_counts(stream, key="id", tags="tags", size=20)
        reservoir.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out"))
        seen = rows.agg(F.max("seen")).first()[0]
        return seen, {r.tag: r.n for r in rows.where(F.col("seen") == seen).collect()}

    seen, counts = add(range(12))
    assert seen == 12 and sum(n for t, n in counts.items() if t[0] == "t") == 12
    seen, counts = add(range(12, 400))
    kept = {int(t[1:]) for t in counts if t[0] == "x"}
    assert seen == 400 and len(kept) == 20 and sum(n for t, n in counts.items() if t[0] == "t") == 20
    assert len([i for i in kept if i >= 12]) >= 10  # 19.4 are expected
    assert {t: n for t, n in counts.items() if t[0] == "t"} == {f"t{k}": n for k in range(4) if (n := sum(i % 4 == k for i in kept))}


def test_append_sink(spark, tmp_path, pieces):
    stream, whole, _ = pieces
    sinks.append_batches(stream.select("seq", "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert readers.csv_table(spark, str(tmp_path / "out"), "seq bigint, state string").count() == whole.count()


def test_json_lines_stream_and_keywords(rows):
    lines = rows([(' {"city": "Ajax", "state": "ON", "x": 1} ',), ("no json",)], "value string")
    assert [r.city for r in readers.json_stream(lines).collect()] == ["Ajax", None]
    texts = rows([("Pizza night",), ("tea",), (None,)], "t string")
    assert readers.with_keywords(texts, "t", ["PIZZA"]).count() == 1
    tags = rows([(([("a",), ("b",)],),)], "entities struct<hashtags: array<struct<text: string>>>")
    assert [r.tag for r in readers.hashtags_of(tags).collect()] == ["a", "b"]


def test_files(spark, rows, tmp_path):
    (tmp_path / "r.csv").write_text('user_id, business_id, stars\nu1,b1,4.0\n"u,2", b2,\n')
    got = readers.ratings_csv(spark, str(tmp_path / "r.csv"))
    assert tuples(got) == [("u,2", "b2", None), ("u1", "b1", 4.0)]
    (tmp_path / "g.txt").write_text("a b\nb c\n")
    assert tuples(readers.edge_list(spark, str(tmp_path / "g.txt"))) == [("a", "b"), ("b", "c")]
    (tmp_path / "s.csv").write_text('d,c,x,x,x,p\n"1/1/00","7","","","","12"\n"1/1/00","8","","","","q"\n')
    assert tuples(readers.retail_baskets(spark, str(tmp_path / "s.csv"))) == [("1/1/00-7", 12), ("1/1/00-8", None)]
    (tmp_path / "u.json").write_text('{"user_id": "u", "review_count": 3}\nbroken\n')
    assert readers.json_lines(spark, str(tmp_path / "u.json"), readers.USERS).where("user_id = 'u' and review_count = 3").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "u.json"), readers.USERS, strict=True).collect()
    assert readers.text_lines(spark, str(tmp_path / "g.txt")).count() == 2

    sinks.write_csv(rows([("a", 1.5)], "state string, stars double"), str(tmp_path / "o.csv"), single=True)
    assert [p.read_text() for p in (tmp_path / "o.csv").glob("*.csv")] == ["state,stars\na,1.5\n"]
    sinks.write_similar_pairs(rows([("b", "c", 1.0), ("a", "b", 0.5)], "x string, y string, s double"), str(tmp_path / "p.csv"))
    sinks.write_json_object({"n": rows([(3,)], "n int"), "top": rows([("a", 2)], "name string, c int")}, str(tmp_path / "o.json"))
    text = next((tmp_path / "o.json").glob("*.json")).read_text()
    assert json.loads(text) == {"n": 3, "top": [{"name": "a", "c": 2}]}
    between = rows([("a", "b", 2.0), ("b", "c", 3.0)], "src string, dst string, betweenness double")
    sinks.write_lines(sinks.betweenness_lines(between), "line", str(tmp_path / "b.txt"))
    assert next((tmp_path / "b.txt").glob("*.txt")).read_text() == "('b', 'c'), 3.0\n('a', 'b'), 2.0\n"
    lines = graph.community_lines(rows([("b", 1), ("a", 1), ("c", 2)], "id string, community int"))
    assert [tuple(r) for r in lines.collect()] == [(1, "'c'"), (2, "'a', 'b'")]
