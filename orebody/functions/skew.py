"""Finding and salting hot keys without counting every key.

Keys are counted by hash bucket, so the count table has a fixed size whatever the data. A key
with more than `share` of the rows always lies in a hot bucket; a rare key that shares one is
salted too, which is harmless. At most 1/share buckets can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def bucket_of(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, *keys: str | Column, share: float = 1 / 200, least: int = 50_000) -> list[int]:
    """Buckets of `keys` that hold more than `share` of the rows, and more than `least` rows.

    One map-side combined count of at most 4,096 groups; at most 1/share numbers come back.
    """
    counts = df.groupBy(bucket_of(*keys).alias("_bucket")).count().collect()
    total = sum(r["count"] for r in counts)
    return sorted(r["_bucket"] for r in counts if r["count"] > max(least, share * total))


def salt_of(hot: list[int], keys: list[str | Column], by: list[str | Column], salts: int = 64) -> Column:
    """0 for keys in cool buckets, else one of `salts` numbers decided by the columns `by`."""
    if not hot:
        return F.lit(0)
    return F.when(bucket_of(*keys).isin(hot), F.pmod(F.xxhash64(*by, F.lit(7)), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], *, least: int = 2_000, salts: int = 64) -> DataFrame:
    """Inner join on `keys` in which a hot key of `left` is worked off by many tasks.

    Its rows on the left are dealt out by the columns `by`, those on the right are repeated for each
    deal; other keys are joined as they are. `left` is counted once by bucket, so it should be cheap
    to read. For joins of a table with itself, where a key costs its square.
    """
    hot = hot_buckets(left, *keys, least=least)
    if not hot:
        return left.join(right, keys)
    right = right.withColumn("_deal", F.explode(all_salts(hot, keys, salts)))
    return left.withColumn("_deal", salt_of(hot, keys, by, salts)).join(right, [*keys, "_deal"]).drop("_deal")


def all_salts(hot: list[int], keys: list[str | Column], salts: int = 64) -> Column:
    """Array of every salt that `salt_of` can give for these keys: the other side of a salted join."""
    if not hot:
        return F.array(F.lit(0))
    return F.when(bucket_of(*keys).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
