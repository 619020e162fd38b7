"""Frequent itemsets by levels, each level extending the occurrences of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.skew import split_join
from orebody.session import cut


def baskets(df: DataFrame, case: int, user: str = "user_id", business: str = "business_id") -> DataFrame:
    """(basket, item): users' businesses in case 1, businesses' users in case 2."""
    if case not in (1, 2):
        raise ValueError("case must be 1 or 2")
    key, item = (user, business) if case == 1 else (business, user)
    return df.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("basket"), F.col(item).alias("item"))


def longer_than(df: DataFrame, threshold: int) -> DataFrame:
    """Baskets of more than `threshold` rows, repeated items counted."""
    sizes = df.groupBy("basket").agg(F.count("*").alias("_n")).where(F.col("_n") > threshold)
    return df.join(sizes.select("basket"), "basket", "left_semi")


def frequent_itemsets(df: DataFrame, min_count: int, *, basket: str = "basket", item: str = "item", max_size: int | None = None) -> DataFrame:
    """(k, itemset, support) of every set of items in at least `min_count` baskets, exactly.

    Items are sorted within a set; repeated rows count once, rows with a null are left out. A level
    joins the occurrences of frequent sets with the frequent items of the same basket that sort
    behind their last one, counts, and keeps the occurrences of sets that stay frequent: nothing
    infrequent is carried on, and no candidate is tested against a basket that lacks it.
    """
    rows = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("b"), F.col(item).alias("i")).distinct()
    single = rows.groupBy("i").agg(F.count("*").alias("support")).where(F.col("support") >= min_count)
    rows = cut(rows.join(single.select("i"), "i", "left_semi"))
    held = rows.select("b", F.array("i").alias("s"), F.col("i").alias("last"))
    out = single.select(F.lit(1).alias("k"), F.array("i").alias("itemset"), "support")
    k = 1
    while max_size is None or k < max_size:
        k += 1
        grown = split_join(held, rows, ["b"], ["s"]).where(F.col("i") > F.col("last")).select("b", F.concat("s", F.array("i")).alias("s"), F.col("i").alias("last"))
        level = cut(grown.groupBy("s").agg(F.count("*").alias("support")).where(F.col("support") >= min_count))
        if level.isEmpty():
            break
        out = out.unionByName(level.select(F.lit(k).alias("k"), F.col("s").alias("itemset"), "support"))
        held = cut(grown.join(level.select("s"), "s", "left_semi"))
    return out


def son_candidates(df: DataFrame, min_count: int, *, chunks: int = 4, basket: str = "basket", item: str = "item") -> DataFrame:
    """(k, itemset) of sets that are frequent, in proportion, in at least one of `chunks` parts of the baskets.

    What the first pass of the two-pass method would count; every frequent set is among them. Baskets
    fall into parts by the first two signs of the MD5 of their name.
    """
    part = F.conv(F.substring(F.md5(F.col("b").cast("string")), 1, 2), 16, 10).cast("int") % chunks
    least = -(-min_count // chunks)
    rows = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("b"), F.col(item).alias("i")).distinct().withColumn("c", part)
    single = rows.groupBy("c", "i").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = cut(rows.join(single.select("c", "i"), ["c", "i"], "left_semi"))
    held = rows.select("c", "b", F.array("i").alias("s"), F.col("i").alias("last"))
    out, k = single.select(F.lit(1).alias("k"), F.array("i").alias("itemset")), 1
    while True:
        k += 1
        grown = split_join(held, rows, ["c", "b"], ["s"]).where(F.col("i") > F.col("last")).select("c", "b", F.concat("s", F.array("i")).alias("s"), F.col("i").alias("last"))
        level = cut(grown.groupBy("c", "s").agg(F.count("*").alias("n")).where(F.col("n") >= least))
        if level.isEmpty():
            return out.distinct()
        out = out.unionByName(level.select(F.lit(k).alias("k"), F.col("s").alias("itemset")))
        held = cut(grown.join(level.select("c", "s"), ["c", "s"], "left_semi"))


def phase_report(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(phase, k, line): candidates and frequent itemsets, each by size."""
    return itemset_report(candidates).withColumn("phase", F.lit("Candidates:")).unionByName(itemset_report(found).withColumn("phase", F.lit("Frequent Itemsets:"))).select("phase", "k", "line")


def itemset_report(found: DataFrame) -> DataFrame:
    """(k, line): the sets of each size in order, written ('a', 'b')."""
    text = F.concat(F.lit("('"), F.array_join(F.transform("itemset", lambda x: x.cast("string")), "', '"), F.lit("')"))
    return found.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("line")).orderBy("k")
