"""Sources: declared schemas, so nothing is inferred and only used columns are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.session import ship_package

USERS = "user_id string, name string, review_count bigint, yelping_since string, useful bigint, funny bigint, cool bigint, fans bigint, average_stars double"
BUSINESSES = "business_id string, name string, address string, city string, state string, postal_code string, latitude double, longitude double, stars double, review_count bigint, is_open bigint"
REVIEWS = "review_id string, user_id string, business_id string, stars double, date string, useful bigint, funny bigint, cool bigint, text string"
TIPS = "user_id string, business_id string, text string"
BUSINESS_EVENTS = "business_id string, name string, neighborhood string, city string, state string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, a Parquet file or a folder of them."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, *, strict: bool = False) -> DataFrame:
    """JSON lines by field name. `strict` fails on a line that does not parse; else its fields are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType, *, header: bool = True) -> DataFrame:
    """Headered CSV; blanks around column names and values are dropped, quotes are honoured."""
    return spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, "user_id string, business_id string, stars double")


def retail_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(basket, item) of a retail export: basket is `date-customer` of columns 0 and 1, item is column 5."""
    raw = csv_table(spark, path, "c0 string, c1 string, c2 string, c3 string, c4 string, c5 string")
    return raw.select(F.concat_ws("-", "c0", "c1").alias("basket"), F.expr("try_cast(c5 as bigint)").alias("item"))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a text file with one space between two ids a line."""
    return spark.read.schema("src string, dst string").option("sep", " ").csv(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def json_stream(lines: DataFrame, schema: str = BUSINESS_EVENTS) -> DataFrame:
    """Fields of a stream of JSON lines in the column `value`; blanks around a line are dropped."""
    return lines.select(F.from_json(F.trim("value"), schema).alias("r")).select("r.*")


def parquet_stream(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def hashtags_of(tweets: DataFrame, column: str = "entities.hashtags") -> DataFrame:
    """One row for each tag of a tweet: `tag`."""
    return tweets.select(F.explode(column).alias("h")).select(F.col("h.text").alias("tag"))


def with_keywords(texts: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose text holds any of the words, whatever their case."""
    low = F.lower(F.col(column))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return texts.where(F.coalesce(hit, F.lit(False)))
