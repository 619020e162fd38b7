"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.addresses import location_pairs, same_locations
from orebody.llm.chosen_path import similar_classes, similar_pairs
from orebody.llm.cooccur import cooccurring_pairs
from orebody.llm.encode import decode_corpus, encode_corpus
from orebody.llm.iceberg import frequent_items
from orebody.llm.langid import fit_languages, identify_languages
from orebody.llm.leaks import find_leaks
from orebody.llm.reservoir import fixed_size_sample
from orebody.llm.seen import digested, seen_before, wrong_answer_rate
from orebody.sources.readers import table


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 tweets with a hashtag, each such row equally likely."""
    return fixed_size_sample(table(spark, sf_dir, "tweet").where(F.size("hashtags") > 0), 150)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of business_stream whose city was received before."""
    seen = seen_before(table(spark, sf_dir, "business_stream"), table(spark, sf_dir, "city_history"), key="city", order="seq")
    return seen.where("seen").select("seq")


def p2_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of wrong answers of `p2_found`."""
    return wrong_answer_rate(table(spark, sf_dir, "business_stream"), table(spark, sf_dir, "city_history"), key="city", order="seq")


def p2_rate_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with hashes of 20 bits, where wrong answers do occur."""
    return wrong_answer_rate(table(spark, sf_dir, "business_stream"), table(spark, sf_dir, "city_history"), key="city", order="seq", bits=20, hashed=digested)


def tag_of(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^#+", ""))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with at least 1/400 of all elements of tweet.hashtags."""
    return p3_counts(spark, sf_dir).select("tag")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "tweet").select(F.explode("hashtags").alias("h")).select(tag_of(F.col("h.text")).alias("tag"))
    return frequent_items(tags, "tag", 400).select("tag", "n")


P2_SQL = """
WITH s AS (SELECT seq, city, min(seq) OVER (PARTITION BY city) AS f FROM business_stream WHERE trim(city) <> '')
SELECT DISTINCT seq FROM s WHERE seq > f OR city IN (SELECT city FROM city_history WHERE city IS NOT NULL)
"""
P2_RATE_SQL = """
WITH s AS (SELECT seq, city, min(seq) OVER (PARTITION BY city) AS f FROM business_stream WHERE trim(city) <> ''),
     r AS (SELECT count(*) AS records, count(*) FILTER (seq > f OR city IN (SELECT city FROM city_history WHERE city IS NOT NULL)) AS seen,
                  count(DISTINCT city) FILTER (city NOT IN (SELECT city FROM city_history WHERE city IS NOT NULL)) AS n FROM s)
SELECT 64::INT AS bits, records, seen, 0::BIGINT AS wrong, 0.0::DOUBLE AS wrong_rate,
       (n + (SELECT count(*) FROM city_history)) / 18446744073709551616.0::DOUBLE AS expected_rate_of_new_keys FROM r
"""
P2_RATE_20_SQL = """
WITH a AS (SELECT seq, city, substr(md5(city), 1, 5) AS h FROM business_stream WHERE trim(city) <> ''),
     o AS (SELECT DISTINCT city, substr(md5(city), 1, 5) AS h FROM city_history WHERE trim(city) <> ''),
     s AS (SELECT *, min(seq) OVER (PARTITION BY city) AS f, min(seq) OVER (PARTITION BY h) AS g FROM a),
     r AS (SELECT seq, city, seq > f OR city IN (SELECT city FROM o) AS was, seq > g OR h IN (SELECT h FROM o) AS said FROM s)
SELECT 20::INT AS bits, count(*) AS records, count(*) FILTER (said) AS seen, count(*) FILTER (said <> was) AS wrong,
       count(*) FILTER (said <> was) / count(*)::DOUBLE AS wrong_rate,
       (count(DISTINCT city) FILTER (city NOT IN (SELECT city FROM o)) + (SELECT count(*) FROM city_history)) / 1048576.0::DOUBLE AS expected_rate_of_new_keys FROM r
"""
P3_SQL = r"""
WITH t AS (SELECT lower(regexp_replace(regexp_replace(u.h.text, '^\s+|\s+$', '', 'g'), '^#+', '')) AS tag
           FROM tweet, unnest(hashtags) AS u(h))
SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY tag HAVING count(*) * 400 >= (SELECT count(*) FROM t)
"""

QUERIES = {"p1_sample": p1_sample, "p2_found": p2_found, "p2_rate": p2_rate, "p2_rate_20": p2_rate_20, "p3_found": p3_found, "p3_counts": p3_counts}
SQL = {"p2_found": P2_SQL, "p2_rate": P2_RATE_SQL, "p2_rate_20": P2_RATE_20_SQL, "p3_found": f"SELECT tag FROM ({P3_SQL})", "p3_counts": P3_SQL}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of businesses whose user sets have Jaccard similarity 0.5 or more."""
    pairs = similar_pairs(table(spark, sf_dir, "yelp_train"), record="business_id", token="user_id", threshold=0.5, min_size=5)
    return pairs.selectExpr("record_1 AS business_id_1", "record_2 AS business_id_2")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each business, the class of businesses with the same users, and how many similar classes that has."""
    members, classes = similar_classes(table(spark, sf_dir, "yelp_train"), record="business_id", token="user_id", threshold=0.5, min_size=5)
    ends = classes.select(F.explode(F.array("class_1", "class_2")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select("business_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of businesses met together in at least 8 baskets and 5 times as often as by chance, with their counts."""
    pairs = cooccurring_pairs(table(spark, sf_dir, "yelp_train"), basket="user_id", item="business_id", min_both=8, min_ratio=5)
    return pairs.select(F.col("item_1").alias("business_id_1"), F.col("item_2").alias("business_id_2"), "n_both", "n_1", "n_2", "n_baskets", F.round("ratio", 6).alias("ratio"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_lift(spark, sf_dir).select("business_id_1", "business_id_2")


_SETS = """
WITH x AS (SELECT DISTINCT business_id AS b, user_id AS u FROM yelp_train WHERE business_id IS NOT NULL AND user_id IS NOT NULL),
     n AS (SELECT b, count(*) AS n FROM x GROUP BY b)"""
P4_SQL = f"""{_SETS},
     y AS (SELECT x.*, n FROM x JOIN n USING (b) WHERE n >= 5)
SELECT p.b AS business_id_1, q.b AS business_id_2 FROM y p JOIN y q ON p.u = q.u AND p.b < q.b AND 2 * least(p.n, q.n) >= greatest(p.n, q.n)
GROUP BY p.b, q.b, p.n, q.n HAVING 2 * count(*) >= p.n + q.n - count(*)
"""
P4_CLASSES_SQL = f"""{_SETS},
     y AS (SELECT x.*, n FROM x JOIN n USING (b) WHERE n >= 5),
     c AS (SELECT b, min(b) OVER (PARTITION BY k) AS class_id FROM (SELECT b, string_agg(u, ',' ORDER BY u) AS k FROM y GROUP BY b)),
     z AS (SELECT * FROM y WHERE b IN (SELECT class_id FROM c)),
     l AS (SELECT p.b AS l, q.b AS r FROM z p JOIN z q ON p.u = q.u AND p.b < q.b GROUP BY p.b, q.b, p.n, q.n HAVING 2 * count(*) >= p.n + q.n - count(*)),
     e AS (SELECT class_id, count(*) AS n_links FROM (SELECT l AS class_id FROM l UNION ALL SELECT r FROM l) GROUP BY 1)
SELECT b AS business_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN e USING (class_id)
"""
P5_SQL = f"""{_SETS},
     t AS (SELECT count(DISTINCT u) AS n FROM x),
     y AS (SELECT x.*, n.n FROM x JOIN n USING (b), t WHERE n.n >= 8 AND n.n * 5 <= t.n)
SELECT p.b AS business_id_1, q.b AS business_id_2, count(*) AS n_both, p.n AS n_1, q.n AS n_2, t.n AS n_baskets, round(count(*) * t.n::DOUBLE / (p.n * q.n), 6) AS ratio
FROM y p JOIN y q ON p.u = q.u AND p.b < q.b, t
GROUP BY p.b, q.b, p.n, q.n, t.n HAVING count(*) >= 8 AND count(*) * t.n >= 5 * p.n * q.n
"""
QUERIES |= {"p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_lift": p5_lift}
SQL |= {"p4_found": P4_SQL, "p4_classes": P4_CLASSES_SQL, "p5_found": f"SELECT business_id_1, business_id_2 FROM ({P5_SQL})", "p5_lift": P5_SQL}


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document under byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document as its tokens decode."""
    back = decode_corpus(encode_corpus(table(spark, sf_dir, "documents"), key="doc_id", text="text"), key="doc_id")
    return back.select("doc_id", F.md5("text").alias("digest"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 words in a row of an evaluation passage, or all of a shorter one."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), doc="doc_id", text="text", item="item_id", passage="passage")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where one word in twelve may be another, missing or added."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), doc="doc_id", text="text", item="item_id", passage="passage", edits=1)


P9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS l FROM documents WHERE text IS NOT NULL),
     p AS (SELECT item_id, l, least(12, len(l)) AS n FROM (SELECT item_id, regexp_extract_all(passage, '[\p{L}\p{N}]+') AS l FROM eval_items) WHERE len(l) > 0),
     pw AS (SELECT DISTINCT item_id, n, lower(array_to_string(list_slice(l, k, k + n - 1), ' ')) AS g FROM (SELECT *, unnest(range(1, len(l) - n + 2)) AS k FROM p)),
     dw AS (SELECT doc_id, n, lower(array_to_string(list_slice(l, k, k + n - 1), ' ')) AS g FROM (SELECT *, unnest(range(1, len(l) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM pw)))
SELECT DISTINCT doc_id, item_id FROM dw JOIN pw USING (n, g)
"""
P8_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"
QUERIES |= {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p9_near": p9_near}
SQL |= {"p8_round_trip": P8_SQL, "p9_found": P9_SQL}


def _languages(spark: SparkSession, sf_dir: str, docs: DataFrame, **more) -> DataFrame:
    every, aliases = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_alias")
    model = fit_languages(every, aliases, key="doc_id", text="text", label="lang", alias="label", language="lang")
    return identify_languages(docs, model, key="doc_id", text="text", **more)


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of one language in each document, with its confidence."""
    held = _languages(spark, sf_dir, table(spark, sf_dir, "documents"))
    return held.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.*")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the texts that hold several, or whose label is missing, unknown or not among them."""
    docs = table(spark, sf_dir, "documents").where(F.length(F.regexp_replace("text", r"\P{L}+", "")) >= 10)
    aliases = F.broadcast(table(spark, sf_dir, "lang_alias").toDF("label", "named"))  # of fixed size
    held = _languages(spark, sf_dir, docs, keep=["lang"]).select("doc_id", F.col("lang").alias("label"), F.transform("languages", lambda x: x["lang"]).alias("langs"))
    case = (F.size("langs") > 1) | F.col("named").isNull() | ~F.array_contains("langs", F.col("named"))
    return held.join(aliases, "label", "left").where(case).select("doc_id", F.explode("langs").alias("lang"))


QUERIES |= {"p10_found": p10_found, "p10_segments": p10_segments}


def p7_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location of each business, and how many businesses stand there."""
    located = same_locations(table(spark, sf_dir, "business"), key="business_id", address="address", city="city", postcode="postal_code")
    sizes = located.groupBy("location").agg(F.count("*").alias("n"))
    return located.join(sizes, "location").select("business_id", "location", "n")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of businesses at the same building number of the same street of the same town."""
    located = same_locations(table(spark, sf_dir, "business"), key="business_id", address="address", city="city", postcode="postal_code")
    return location_pairs(located, key="business_id").toDF("business_id_1", "business_id_2")


QUERIES |= {"p7_found": p7_found, "p7_locations": p7_locations}
