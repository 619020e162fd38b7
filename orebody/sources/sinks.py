"""Sinks: CSV, JSON and report files, and append-per-batch stream output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """Headered CSV; `single` makes one file, for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json_object(results: dict[str, DataFrame], path: str) -> None:
    """One JSON object: the value of a one-row one-column frame, else a list of rows.

    For reports: each frame is collected into one row by the executors.
    """
    spark = next(iter(results.values())).sparkSession
    parts = []
    for name, df in results.items():
        row = F.struct(*df.columns)
        parts.append(df.agg((F.first(df.columns[0]) if len(df.columns) == 1 else F.collect_list(row)).alias(name)))
    whole = spark.range(1).drop("id")
    for p in parts:
        whole = whole.join(p, F.lit(True))
    whole.coalesce(1).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text line a row, in the order of the frame's last sort."""
    df.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def betweenness_lines(df: DataFrame) -> DataFrame:
    """(line): ('a', 'b'), value - by falling value, then names."""
    return df.orderBy(F.desc("betweenness"), "src", "dst").select(F.format_string("('%s', '%s'), %s", "src", "dst", F.col("betweenness").cast("string")).alias("line"))


def write_similar_pairs(df: DataFrame, path: str) -> None:
    write_csv(df.orderBy(*df.columns[:2]), path)


def write_predictions(df: DataFrame, path: str) -> None:
    """user_id, business_id, prediction of (user, item, prediction), by both keys."""
    write_csv(df.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "prediction").orderBy("user_id", "business_id"), path)


def write_timed(df: DataFrame, time: str, names: dict[str, str], path: str) -> None:
    """A stream's results as one CSV file: Time and the columns named, in order of time."""
    columns = [F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("Time"), *[F.col(old).alias(new) for old, new in names.items()]]
    write_csv(df.orderBy(time).select(*columns), path, single=True)


def console(df: DataFrame, checkpoint: str, **trigger):
    """Starts a stream that prints each batch."""
    return df.writeStream.outputMode("update").format("console").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_batches(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a stream that appends each batch's rows as headered CSV; {} runs what is there and stops."""
    return df.writeStream.outputMode("append").format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
