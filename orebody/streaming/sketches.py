"""Streaming forms of the sketches, each equal to its batch form on the same rows.

Bloom and reservoir keep their state as tables in a folder, a part a micro-batch, so a repeated
batch overwrites its own part and a lost executor costs nothing but its task. All work is done by
the executors; the driver sees no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from orebody.functions.hashing import HASH_TABLE, string_hashes, trailing_zeros
from orebody.operators.sketches import BITS, fm_combined


def _before(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """What the batches before this one wrote."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < batch).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def bloom_stream(stream: DataFrame, state: str, checkpoint: str, *, element: str, order: str, bits: int = BITS, **trigger) -> StreamingQuery:
    """Keeps (batch, fp, tn, fpr) of `bloom_rates(state)` up to date, batch by batch.

    New elements of a batch are those in no earlier batch; within it, bits count as set from the
    first element that sets them, by order. Null elements are left out.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        known = _before(spark, f"{state}/elements", batch, "e string, f bigint, fp boolean")
        new = rows.where(F.col(element).isNotNull() & F.col(order).isNotNull()).groupBy(F.col(element).alias("e")).agg(F.min(order).cast("bigint").alias("f")).join(known.select("e"), "e", "left_anti")
        own = new.select("e", "f", F.explode(F.array_distinct(string_hashes(F.col("e"), bits))).alias("bit"))
        before = _before(spark, f"{state}/bits", batch, "bit bigint").select("bit", F.lit(-(1 << 62)).alias("f"))  # at most `bits` rows in all
        since = own.select("bit", "f").unionByName(before).groupBy("bit").agg(F.min("f").alias("since"))
        fresh = own.join(F.broadcast(since), "bit").groupBy("e", "f").agg(F.bool_and(F.col("since") < F.col("f")).alias("fp"))
        fresh.write.mode("overwrite").parquet(f"{state}/elements/batch={batch}")
        own.select(F.col("bit").cast("bigint")).distinct().join(before.select("bit"), "bit", "left_anti").write.mode("overwrite").parquet(f"{state}/bits/batch={batch}")
        spark.range(1).select(F.current_timestamp().alias("time")).write.mode("overwrite").parquet(f"{state}/batches/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bloom_rates(spark: SparkSession, state: str) -> DataFrame:
    """(batch, time, fp, tn, fpr), counts up to the end of each batch; fpr is null before the first element."""
    from pyspark.sql import Window

    every = spark.read.schema("time timestamp, batch bigint").parquet(f"{state}/batches").groupBy("batch").agg(F.max("time").alias("time"))
    each = spark.read.schema("e string, f bigint, fp boolean, batch bigint").parquet(f"{state}/elements").groupBy("batch").agg(F.count_if("fp").alias("fp"), F.count_if(~F.col("fp")).alias("tn"))
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    out = every.join(each, "batch", "left").select("batch", "time", F.sum(F.coalesce("fp", F.lit(0))).over(upto).alias("fp"), F.sum(F.coalesce("tn", F.lit(0))).over(upto).alias("tn"))
    return out.withColumn("fpr", F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")))


def flajolet_martin_stream(stream: DataFrame, *, element: str, time: str, window: str, slide: str, late: str, m: int = BITS) -> DataFrame:
    """Streaming (window_start, window_end, n_distinct, estimate); a window comes out once the watermark has passed its end."""
    rows = stream.where(F.col(element).isNotNull()).withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    rows = rows.withColumn("_tails", F.transform(string_hashes(F.col(element), m), trailing_zeros))
    most = rows.groupBy(F.window("_time", window, slide).alias("w")).agg(F.size(F.collect_set(element)).alias("n_distinct"), *[F.max(F.get("_tails", F.lit(j))).alias(f"r{j}") for j in range(len(HASH_TABLE))])
    return most.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_distinct", fm_combined([F.col(f"r{j}") for j in range(len(HASH_TABLE))]).alias("estimate"))


def reservoir_stream(stream: DataFrame, state: str, checkpoint: str, *, key: str, size: int = 150, **trigger) -> StreamingQuery:
    """Keeps in `state/batch=N` the sample after batch N: the `size` distinct keys of least MD5 so far.

    Every key is equally likely to be kept, whenever it comes; a batch adds at most `size` rows to
    what is carried on. Read the last with `reservoir_rows`.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = _last(_before_with_batch(spark, state, batch, schema))
        all_rows = rows.where(F.col(key).isNotNull()).unionByName(last)
        all_rows.dropDuplicates([key]).orderBy(F.md5(F.col(key).cast("string"))).limit(size).write.mode("overwrite").parquet(f"{state}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _before_with_batch(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < batch)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch bigint")


def _last(parts: DataFrame) -> DataFrame:
    newest = parts.agg(F.max("batch").alias("_newest"))
    return parts.join(F.broadcast(newest), F.col("batch") == F.col("_newest")).drop("batch", "_newest")


def reservoir_rows(spark: SparkSession, state: str, schema: str) -> DataFrame:
    """The sample after the last batch."""
    return _last(spark.read.schema(f"{schema}, batch bigint").parquet(state))
