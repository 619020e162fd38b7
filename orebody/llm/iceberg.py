"""Most frequent items by iceberg multi-hash filtering, in memory that does not follow the data.

First pass: every value is counted into one bucket of each of several hashes, exactly. A value with
at least the threshold fills its bucket to the threshold under every hash, and at most 1/support
buckets of a hash can be so full. Second pass: values with a light bucket anywhere are dropped;
the few that are left are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _buckets(value: Column, hashes: int, buckets: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(j)), F.lit(buckets)).cast("int") for j in range(hashes)]


def frequent_items(items: DataFrame, value: str, one_in: int, *, hashes: int = 4, buckets: int = 8192) -> DataFrame:
    """(value, n, share) of the values with at least one `one_in`-th of all rows, exactly counted.

    Null values belong to the total, but are no value; the empty string is one. Ties need no care,
    an empty table gives no rows. `buckets` should be several times `one_in`: a rare value stays by
    chance with probability below (one_in / buckets) ** hashes, and only costs its count. Both
    passes combine before the shuffle: the first moves at most hashes x buckets rows a task, the
    second the surviving values.
    """
    if one_in < 1 or buckets < one_in:
        raise ValueError("needs 1 <= one_in <= buckets")
    v = F.col(value)
    spots = [F.struct(F.lit(j).alias("j"), F.when(v.isNotNull(), b).alias("b")) for j, b in enumerate(_buckets(v, hashes, buckets))]
    coarse = items.select(F.inline(F.array(*spots))).groupBy("j", "b").count().collect()  # at most hashes * (buckets + 1) rows
    total = sum(r["count"] for r in coarse if r["j"] == 0)
    full = [sorted(r["b"] for r in coarse if r["j"] == j and r["b"] is not None and r["count"] * one_in >= total) for j in range(hashes)]
    kept = items.where(v.isNotNull())
    for heavy, b in zip(full, _buckets(v, hashes, buckets)):
        kept = kept.where(b.isin(heavy) if heavy else F.lit(False))
    out = kept.groupBy(v.alias(value)).agg(F.count("*").alias("n")).where(F.col("n") * one_in >= total)
    return out.withColumn("share", F.col("n") / F.lit(float(max(total, 1))))
