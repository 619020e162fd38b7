"""Batch forms of the stream sketches: Bloom filter error rate, Flajolet-Martin, reservoir."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.hashing import HASH_TABLE, string_hashes, trailing_zeros

BITS = 200
GROUPS = 4


def bloom_error_rate(df: DataFrame, *, element: str, order: str, batch: str, bits: int = BITS) -> DataFrame:
    """(batch, fp, tn, fpr): false positives and true negatives up to the end of each batch, by order of arrival.

    An element that arrives for the first time is a false positive if all its bits are set already.
    Repeats change nothing, so each element counts once, at its first row; which bits are set is a
    table of at most `bits` rows. Null elements are left out; fpr is null before the first element.
    """
    first = df.where(F.col(element).isNotNull() & F.col(order).isNotNull()).groupBy(F.col(element).alias("e")).agg(F.min(order).alias("f"), F.min_by(batch, order).alias("batch"))
    first = first.select("f", "batch", F.explode(F.array_distinct(string_hashes(F.col("e"), bits))).alias("bit"))
    since = first.groupBy("bit").agg(F.min("f").alias("since"))
    each = first.join(F.broadcast(since), "bit").groupBy("f", "batch").agg(F.bool_and(F.col("since") < F.col("f")).alias("fp"))
    news = each.groupBy("batch").agg(F.count_if("fp").alias("fp"), F.count_if(~F.col("fp")).alias("tn"))
    every = df.where(F.col(batch).isNotNull()).select(F.col(batch).alias("batch")).distinct()
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row a batch
    out = every.join(news, "batch", "left").select("batch", F.sum(F.coalesce("fp", F.lit(0))).over(upto).alias("fp"), F.sum(F.coalesce("tn", F.lit(0))).over(upto).alias("tn"))
    return out.withColumn("fpr", F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")))


def fm_combined(tails: list[Column], groups: int = GROUPS) -> Column:
    """Estimate from the longest tails: means of 2**tail in consecutive groups, then the upper median."""
    n = len(tails) // groups
    means = [sum((F.pow(F.lit(2.0), t) for t in tails[g * n + 1 : (g + 1) * n]), F.pow(F.lit(2.0), tails[g * n])) / n for g in range(groups)]
    return F.element_at(F.array_sort(F.array(*means)), groups // 2 + 1)


def flajolet_martin(df: DataFrame, *, element: str, time: str, window: str, slide: str, m: int = BITS) -> DataFrame:
    """(window_start, window_end, n_distinct, estimate) for each sliding window that holds an element.

    Hashing runs once a distinct element and window; the 36 maxima combine before the shuffle.
    """
    rows = df.where(F.col(element).isNotNull() & F.col(time).isNotNull()).select(F.window(time, window, slide).alias("w"), F.col(element).alias("e"))
    rows = rows.distinct().select("w", F.transform(string_hashes(F.col("e"), m), trailing_zeros).alias("z"))
    most = rows.groupBy("w").agg(F.count("*").alias("n_distinct"), *[F.max(F.get("z", F.lit(j))).alias(f"r{j}") for j in range(len(HASH_TABLE))])
    return most.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_distinct", fm_combined([F.col(f"r{j}") for j in range(len(HASH_TABLE))]).alias("estimate"))


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """`n` rows of distinct keys, those with the least MD5 of the key: uniform, and the same every time."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key]).orderBy(F.md5(F.col(key).cast("string"))).limit(n)
