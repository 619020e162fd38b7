"""Queries through the sources, sinks and streams: what is written to the shared folder comes back and is worked on."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators import explore, graph, itemsets
from orebody.plans import core, core_sql
from orebody.session import cut, shared_dir
from orebody.sources import readers, sinks
from orebody.sources.readers import table
from orebody.streaming import reservoir
from orebody.streaming import sketches as streams


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, removed with the session."""
    path = f"{shared_dir(spark)}/orebody-{uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def ratings_csv_file(spark, d):
    """The ratings as a CSV file: how often each rating stands in it, and how many of its keys are known."""
    path = _scratch(spark)
    sinks.write_csv(table(spark, d, "yelp_train").select("user_id", "business_id", "stars"), path)
    return readers.ratings_csv(spark, path).groupBy("stars").agg(F.count("*").alias("n"), F.count("user_id").alias("n_users"), F.count("business_id").alias("n_businesses"))


def users_json_file(spark, d):
    """The users as JSON lines, read by field name, with bad lines as an error."""
    path = _scratch(spark)
    table(spark, d, "users").drop("yelping_since").write.json(path)
    rows = readers.json_lines(spark, path, readers.USERS, strict=True)
    return rows.agg(F.count("*").alias("n_rows"), F.sum("review_count").alias("n_reviews"), F.count_distinct("name").alias("n_names"), F.count("yelping_since").alias("n_dates"))


def retail_csv_file(spark, d):
    """Events as a retail export of six columns: baskets a day and customer, and their size."""
    path = _scratch(spark)
    blank = F.lit("-")
    sinks.write_csv(table(spark, d, "events").select(F.date_format("ts", "d/M/yyyy").alias("day"), "user_id", blank.alias("a"), blank.alias("b"), blank.alias("c"), F.floor("value").cast("string").alias("product")), path)
    return readers.retail_baskets(spark, path).groupBy("basket").agg(F.count("*").alias("n"), F.count_distinct("item").alias("n_items"))


def edge_file(spark, d):
    """The business graph as lines `a b`: each vertex's degree."""
    path = _scratch(spark)
    sinks.write_lines(graph.undirected(core.edges(spark, d)).select(F.concat_ws(" ", "src", "dst").alias("line")), "line", path)
    return graph.both_ways(readers.edge_list(spark, path)).groupBy(F.col("src").alias("business_id")).agg(F.count("*").alias("degree"))


def community_file(spark, d):
    """Communities a line, as a text file read back."""
    path = _scratch(spark)
    sinks.write_lines(core.component_lines(spark, d), "members", path)
    return readers.text_lines(spark, path).select(F.col("value").alias("members"))


def betweenness_file(spark, d):
    path = _scratch(spark)
    sinks.write_lines(sinks.betweenness_lines(core.betweenness(spark, d)), "line", path)
    return readers.text_lines(spark, path).select(F.col("value").alias("line"))


def similar_pairs_file(spark, d):
    path = _scratch(spark)
    sinks.write_similar_pairs(core.jaccard_exact(spark, d), path)
    return readers.csv_table(spark, path, "business_id_1 string, business_id_2 string, similarity double")


def predictions_file(spark, d):
    path = _scratch(spark)
    sinks.write_predictions(core.cold_start_default(spark, d).toDF("user", "item", "prediction"), path)
    return readers.csv_table(spark, path, "user_id string, business_id string, prediction double")


def state_csv_file(spark, d):
    path = _scratch(spark)
    sinks.write_csv(core.state_avg(spark, d), path, single=True)
    return readers.csv_table(spark, path, "state string, stars double")


def report_object(spark, d):
    """One JSON object of several results."""
    path = _scratch(spark)
    sinks.write_json_object({"users": core.user_totals(spark, d).select("n_users"), "names": core.distinct_names(spark, d), "top": core.top_reviewers(spark, d)}, path)
    got = readers.json_lines(spark, path, "users bigint, names bigint, top array<struct<user_id: string, review_count: bigint>>", strict=True)
    best = F.array_max(F.transform("top", lambda x: x["review_count"]))
    return got.select("users", "names", F.size("top").alias("n_top"), best.alias("most"))


def renamed_columns(spark, d):
    return explore.renamed(table(spark, d, "business"), {"state": "state", "is_open": "open"}).groupBy("state", "open").agg(F.count("*").alias("n"))


def features_left_join(spark, d):
    """Reviews with the first tip of the same user and business, a left join on two keys."""
    tips = table(spark, d, "documents").where((F.col("source") == "tip") & F.col("user_id").isNotNull() & F.col("business_id").isNotNull())
    first = explore.first_per_key(tips.select("user_id", "business_id", "doc_id"), ["user_id", "business_id"], ["doc_id"])
    return core.reviews(spark, d).join(first, ["user_id", "business_id"], "left").select("review_id", "doc_id")


def itemset_phases(spark, d):
    rows = cut(itemsets.baskets(table(spark, d, "yelp_train"), 1))
    return itemsets.phase_report(itemsets.son_candidates(rows, 40), itemsets.frequent_itemsets(rows, 40))


def keyword_texts(spark, d):
    """Texts that hold a keyword, by source."""
    return readers.with_keywords(table(spark, d, "documents"), "text", ["Soup", "parking"]).groupBy("source").agg(F.count("*").alias("n"))


def _pieces(spark: SparkSession, rows: DataFrame, order: str, n: int = 4) -> tuple[DataFrame, str]:
    """A file stream of `rows` in `n` pieces by `order`, and a folder for its results."""
    path = _scratch(spark)
    ends = rows.agg(F.min(order).cast("bigint").alias("a"), F.max(order).cast("bigint").alias("b")).first()
    low, width = ends["a"] or 0, ((ends["b"] or 0) - (ends["a"] or 0)) // n + 1
    for k in range(n):
        part = rows.where(F.floor((F.col(order).cast("bigint") - low) / width) == k)
        part.write.parquet(f"{path}/in/piece={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in/*"), path


def stream_bloom(spark, d):
    """False positives and true negatives at the end of the stream of states, which comes as one piece, so in order."""
    stream, path = _pieces(spark, table(spark, d, "business_stream").select("seq", "state"), "seq", 1)
    streams.bloom_stream(stream, f"{path}/state", f"{path}/checkpoint", element="state", order="seq").awaitTermination()
    last = streams.bloom_rates(spark, f"{path}/state").orderBy(F.desc("batch")).limit(1)
    sinks.write_timed(last, "time", {"fp": "FP", "tn": "TN", "fpr": "FPR"}, f"{path}/report")
    report = readers.csv_table(spark, f"{path}/report", "time string, fp bigint, tn bigint, fpr double")
    return report.select("fp", "tn", F.round("fpr", 6).alias("fpr"))


def stream_fm(spark, d):
    """The estimates of `fm_estimate`, from the stream, through its timed file."""
    stream, path = _pieces(spark, table(spark, d, "business_stream").select("seq", "city", "received_at"), "seq")
    fm = streams.flajolet_martin_stream(stream, element="city", time="received_at", window="6 hours", slide="2 hours", late="0 seconds")
    whole = fm.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out"))
    whole.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sinks.write_timed(spark.read.parquet(f"{path}/out"), "window_start", {"n_distinct": "Ground Truth", "estimate": "Estimation"}, f"{path}/report")
    report = readers.csv_table(spark, f"{path}/report", "window_start string, n_distinct bigint, estimate double")
    return report.withColumn("estimate", F.round("estimate", 6))


def stream_reservoir(spark, d):
    """The top tags of `reservoir_tags`, from the stream of tweets."""
    rows = table(spark, d, "tweet").where(F.size("hashtags") > 0).select("tweet_id", "batch_no", "hashtags")
    stream, path = _pieces(spark, rows, "batch_no")
    streams.reservoir_stream(stream, f"{path}/state", f"{path}/checkpoint", key="tweet_id").awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    sample = streams.reservoir_rows(spark, f"{path}/state", schema)
    return explore.top_with_ties(cut(core._tag_counts(sample)), "tag", "n").select("tag", "n", "rank")


def stream_algorithm_r(spark, d):
    """Records seen and tags kept by Algorithm R over the stream of tweets with one tag."""
    tags = F.transform("hashtags", lambda h: F.lower(F.trim(h["text"])))
    rows = table(spark, d, "tweet").where(F.size("hashtags") == 1).select("tweet_id", "batch_no", tags.alias("tags"))
    stream, path = _pieces(spark, rows, "batch_no")
    reservoir.write_counts(reservoir.reservoir_counts(stream, key="tweet_id", tags="tags"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("seen").agg(F.sum("n").alias("n_tags")).orderBy(F.desc("seen")).limit(1)


def regression_bound(spark, d):
    """Whether the regression's error is at most twice that of the mean rating of all, even on few rows, and every prediction in range."""
    got, true = core.regression_rating(spark, d), core.truth(spark, d)
    mean = core.ratings(spark, d).agg(F.avg("rating").alias("mean"))
    met = true.join(got.toDF("user", "item", "p"), ["user", "item"]).join(F.broadcast(mean), F.lit(True))
    rmse = lambda x: F.sqrt(F.avg(F.pow(F.col("rating") - x, 2)))
    return met.agg(F.count("*").alias("n"), (rmse(F.col("p")) <= 2 * rmse(F.col("mean"))).alias("close"), F.bool_and(F.col("p").between(1, 5)).alias("in_range"))


def girvan_newman_quality(spark, d):
    """Communities of the best split lie within components, and their modularity is at least that of the components."""
    e = cut(core.edges(spark, d))
    found, whole = cut(graph.girvan_newman(e)[1]), cut(graph.components(e).toDF("id", "community"))
    crossing = found.join(whole.toDF("id", "component"), "id").groupBy("community").agg(F.count_distinct("component").alias("n")).where("n > 1")
    both = graph.modularity(e, found).toDF("best").join(graph.modularity(e, whole).toDF("least"), F.lit(True))
    return both.join(crossing.agg(F.count("*").alias("n_crossing")), F.lit(True)).select("n_crossing", (F.round("best", 9) >= F.round("least", 9)).alias("no_worse"))


def als_range(spark, d):
    """Keys that factorisation predicts, all in range."""
    return core.als_cf(spark, d).agg(F.count("*").alias("n"), F.count_distinct("user_id", "business_id").alias("n_keys"), F.bool_and(F.col("prediction").between(1, 5)).alias("in_range"))


def partition_totals(spark, d):
    """The partition profile in sum: no row is lost, none counted twice."""
    return core.partition_profile(spark, d).agg(F.count("*").alias("n_partitions"), F.sum("n_rows").alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        ratings_csv_file, users_json_file, retail_csv_file, edge_file, community_file, betweenness_file, similar_pairs_file, predictions_file, state_csv_file, report_object, renamed_columns,
        features_left_join, itemset_phases, keyword_texts, stream_bloom, stream_fm, stream_reservoir, stream_algorithm_r, regression_bound, girvan_newman_quality, als_range, partition_totals,
    )
}


def _candidates() -> str:
    """Like the itemsets of `core_sql`, level by level, within parts of the baskets."""
    sql = "WITH w AS (SELECT DISTINCT user_id AS b, business_id AS i, ('0x' || substr(md5(user_id), 1, 2))::INT % 4 AS c FROM yelp_train WHERE user_id IS NOT NULL AND business_id IS NOT NULL), f AS (SELECT c, i FROM w GROUP BY c, i HAVING count(*) >= 10), z AS (SELECT c, b, i FROM w SEMI JOIN f USING (c, i)), o1 AS (SELECT c, b, i AS s, i AS l FROM z), l1 AS (SELECT c, s FROM o1 GROUP BY c, s HAVING count(*) >= 10)"
    for k in range(2, 8):
        sql += f", o{k} AS (SELECT o.c, o.b, o.s || ',' || z.i AS s, z.i AS l FROM o{k - 1} o SEMI JOIN l{k - 1} USING (c, s) JOIN z ON z.b = o.b AND z.i > o.l), l{k} AS (SELECT c, s FROM o{k} GROUP BY c, s HAVING count(*) >= 10)"
    return sql + " " + " UNION ".join(f"SELECT {k}::INT AS k, s AS itemset FROM l{k}" for k in range(1, 8))


def _report(found: str) -> str:
    text = "'(''' || replace(itemset, ',', ''', ''') || ''')'"
    return f"SELECT k, string_agg({text}, ',' ORDER BY {text}) AS line FROM ({found}) GROUP BY k"


_FREQUENT = core_sql._itemsets(core_sql._baskets("user_id", "business_id"), 40, 7)
# all shortest paths of each component, spelt out; the share of each pair's paths that use an edge
_BETWEEN = f"""WITH RECURSIVE {core_sql.EDGES}, p(root, v, path, n) AS (
        SELECT DISTINCT src, src, [src], 0 FROM e UNION ALL SELECT p.root, e.dst, list_append(p.path, e.dst), p.n + 1 FROM p JOIN e ON e.src = p.v WHERE NOT list_contains(p.path, e.dst)),
    q AS (SELECT root, v, path, n FROM p WHERE root < v QUALIFY n = min(n) OVER (PARTITION BY root, v)), c AS (SELECT *, count(*) OVER (PARTITION BY root, v) AS c FROM q),
    s AS (SELECT path[k] AS a, path[k + 1] AS b, c FROM (SELECT path, c, unnest(range(1, len(path))) AS k FROM c)),
    bw AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, round(sum(1.0::DOUBLE / c), 6) AS betweenness FROM s GROUP BY 1, 2)"""
_KEYS = f"{core_sql.T}, {core_sql.U}, b AS (SELECT DISTINCT business_id AS i FROM business WHERE business_id IS NOT NULL)"

SQL = {
    "ratings_csv_file": "SELECT stars, count(*) AS n, count(user_id) AS n_users, count(business_id) AS n_businesses FROM yelp_train GROUP BY stars",
    "users_json_file": "SELECT count(*) AS n_rows, sum(review_count)::BIGINT AS n_reviews, count(DISTINCT name) AS n_names, 0::BIGINT AS n_dates FROM users",
    "retail_csv_file": "SELECT strftime(ts, '%-d/%-m/%Y') || '-' || user_id AS basket, count(*) AS n, count(DISTINCT floor(value)) AS n_items FROM events GROUP BY 1",
    "edge_file": f"WITH {core_sql.EDGES} SELECT src AS business_id, count(*) AS degree FROM e GROUP BY src",
    "community_file": f"SELECT members FROM ({core_sql.SQL['component_lines']})",
    "betweenness_file": f"{_BETWEEN} SELECT '(''' || src || ''', ''' || dst || '''), ' || betweenness AS line FROM bw",
    "similar_pairs_file": core_sql.SQL["jaccard_exact"],
    "predictions_file": core_sql.SQL["cold_start_default"],
    "state_csv_file": core_sql.SQL["state_avg"],
    "report_object": f"SELECT (SELECT n_users FROM ({core_sql.SQL['user_totals']})) AS users, (SELECT n_names FROM ({core_sql.SQL['distinct_names']})) AS names, count(*)::INT AS n_top, max(review_count) AS most FROM ({core_sql.SQL['top_reviewers']})",
    "renamed_columns": "SELECT state, is_open AS open, count(*) AS n FROM business GROUP BY 1, 2",
    "features_left_join": f"WITH {core_sql.V}, d AS (SELECT user_id AS u, business_id AS i, min(doc_id) AS doc_id FROM documents WHERE source = 'tip' AND user_id IS NOT NULL AND business_id IS NOT NULL GROUP BY 1, 2) SELECT review_id, doc_id FROM v LEFT JOIN d ON d.u = v.u AND d.i = v.i",
    "itemset_phases": f"SELECT 'Candidates:' AS phase, k, line FROM ({_report(_candidates())}) UNION ALL SELECT 'Frequent Itemsets:', k, line FROM ({_report(_FREQUENT)})",
    "keyword_texts": "SELECT source, count(*) AS n FROM documents WHERE contains(lower(text), 'soup') OR contains(lower(text), 'parking') GROUP BY source",
    "stream_bloom": f"SELECT fp, tn, fpr FROM ({core_sql.SQL['bloom_fpr']}) ORDER BY hour DESC LIMIT 1",
    "stream_fm": core_sql.SQL["fm_estimate"],
    "stream_reservoir": core_sql.SQL["reservoir_tags"],
    "stream_algorithm_r": "SELECT count(*) AS seen, least(150, count(*))::BIGINT AS n_tags FROM tweet WHERE len(hashtags) = 1 AND hashtags[1].text IS NOT NULL AND tweet_id IS NOT NULL",
    "regression_bound": f"WITH {_KEYS} SELECT count(*) AS n, true AS close, true AS in_range FROM t JOIN u ON u.user_id = t.u JOIN b USING (i)",
    "girvan_newman_quality": "SELECT 0::BIGINT AS n_crossing, true AS no_worse",
    "als_range": f"WITH {core_sql.T} SELECT count(*) AS n, count(*) AS n_keys, true AS in_range FROM t",
    "partition_totals": "SELECT 16::BIGINT AS n_partitions, count(*) AS n_rows FROM review",
    "betweenness": f"{_BETWEEN} SELECT src, dst, betweenness FROM bw",
}
