"""Exploratory aggregation, top-k, partition profiles, clean-up of repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, key: str, newest: str, columns: list[str]) -> DataFrame:
    """Each non-null key once, with `columns` of its row of the largest `newest`: one combined aggregation.

    Rows that tie are told apart by the columns in turn, the larger value first, nulls last, so the
    result is always a row as delivered and always the same one.
    """
    best = F.max(F.struct(F.col(newest).alias("_newest"), *columns)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def column_totals(df: DataFrame, value: str) -> DataFrame:
    """n_rows, total and mean of a column; nulls count as rows, not as values."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n_distinct"))


def count_containing(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text holds `part`: a year in dates of any notation."""
    return df.agg(F.count_if(F.col(column).contains(part)).alias("n_rows"))


def top_groups(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent values by (-count, value); nulls are no value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def top_rows(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The k rows with the largest values, ties by key."""
    return df.where(F.col(value).isNotNull()).select(key, value).orderBy(F.desc(value), key).limit(k)


def top_with_ties(counts: DataFrame, key: str, n: str, k: int = 5) -> DataFrame:
    """Rows of the k largest values of `n` and all that tie with the last, with their rank.

    The k-th value is found by a bounded top-k first, so no sort of all groups is needed.
    """
    kth = counts.where(F.col(n).isNotNull()).orderBy(F.desc(n)).limit(k).agg(F.min(n).alias("_least"))
    kept = counts.join(F.broadcast(kth), F.col(n) >= F.col("_least")).drop("_least")
    return kept.withColumn("rank", F.rank().over(Window.orderBy(F.desc(n))))


def mean_by_group(facts: DataFrame, groups: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """Mean of `value` by `group` over the inner join of facts and groups, by (-mean, group)."""
    joined = facts.where(F.col(value).isNotNull()).select(on, value).join(groups.where(F.col(group).isNotNull()).select(on, group), on)
    return joined.groupBy(group).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), group)


def partition_profile(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows in each of n partitions after repartitioning, empty partitions included."""
    parts = df.repartition(n, *keys).groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_rows"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(parts, "partition", "left").select("partition", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns named by the keys, under the names given."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key, the first by `order`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the place of each distinct non-null value in sorted order, from 0.

    Range partitions are numbered on their own and shifted by the sizes of those before, so no task
    sorts everything.
    """
    from orebody.session import cut

    keys = cut(df.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return keys.withColumn("_own", own).join(F.broadcast(shift), "_part").select(column, (F.col("_own") + F.col("_shift")).cast("bigint").alias(name))
