"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def rating_error_report(predictions: DataFrame, truth: DataFrame, keys: list[str], predicted: str = "prediction", actual: str = "stars") -> DataFrame:
    """Counts of absolute errors in [0,1), [1,2), [2,3), [3,4), [4,..), and the RMSE, over the inner join.

    No common key gives zero counts and a null RMSE.
    """
    e = F.abs(F.col(predicted) - F.col(actual))
    joined = predictions.select(*keys, predicted).join(truth.select(*keys, actual), keys).select(e.alias("e"))
    buckets = [F.count_if((F.col("e") >= k) & (F.col("e") < k + 1)).alias(f"errors_{k}_{k + 1}") for k in range(4)]
    return joined.agg(*buckets, F.count_if(F.col("e") >= 4).alias("errors_4_up"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def pair_precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall of distinct pairs; null where there is nothing to divide by."""
    found, truth = found.select(*keys).distinct(), truth.select(*keys).distinct()
    both = found.withColumn("_f", F.lit(1)).join(truth.withColumn("_t", F.lit(1)), keys, "full")
    hits, n_found, n_true = F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()), F.count("_f"), F.count("_t")
    return both.agg(n_found.alias("n_found"), n_true.alias("n_true"), F.try_divide(hits, n_found).alias("precision"), F.try_divide(hits, n_true).alias("recall"))
