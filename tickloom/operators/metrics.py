"""Rank metrics per group, from sums by score: no pair is ever formed.

Rows have positive boolean, score double and, where weights count, weight double. Undefined results are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import quantiles, sums_before


def _auc_parts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, num (weight of rightly ordered pairs, ties half), wp, wn."""
    w = F.col("weight")
    sums = rows.groupBy(*by, "score").agg(F.sum(F.when(F.col("positive"), w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("positive"), 0.0).otherwise(w)).alias("n"))
    pairs = sums_before(sums, by, "score", {"_below": F.col("n")}).withColumn("_num", F.col("p") * (F.col("_below") + 0.5 * F.col("n")))
    return pairs.groupBy(*by).agg(F.sum("_num").alias("num"), F.sum("p").alias("wp"), F.sum("n").alias("wn"))


def weighted_auc(rows: DataFrame, by: Sequence[str], name: str = "auc") -> DataFrame:
    defined = (F.col("wp") > 0) & (F.col("wn") > 0)
    return _auc_parts(rows, by).select(*by, F.when(defined, F.col("num") / (F.col("wp") * F.col("wn"))).alias(name))


def auc(rows: DataFrame, by: Sequence[str], name: str = "auc") -> DataFrame:
    return weighted_auc(rows.withColumn("weight", F.lit(1.0)), by, name)


def conditional_auc(rows: DataFrame, by: Sequence[str], bucket: str, name: str = "auc") -> DataFrame:
    """Within buckets, pooled by the weight of their pairs; buckets of one class don't count."""
    parts = _auc_parts(rows, [*by, bucket]).where("wp > 0 and wn > 0")
    pooled = parts.groupBy(*by).agg((F.sum("num") / F.sum(F.col("wp") * F.col("wn"))).alias(name))
    return rows.select(*by).distinct().join(pooled, list(by), "left")


def tail_accuracy(rows: DataFrame, by: Sequence[str], quantile: float, bucket: str | None = None, name: str = "tail_accuracy") -> DataFrame:
    """Weighted share of right calls when the top quantile is called positive and the bottom one negative, bounds
    included and interpolated; within buckets of two rows and more if one is named. A row in both tails counts twice."""
    within = [*by, *([bucket] if bucket else [])]
    bounds = quantiles(rows, within, "score", {"_low": (quantile, True), "_high": (1.0 - quantile, True)}).withColumnRenamed("n", "_n")
    if bucket:
        bounds = bounds.where("_n >= 2")
    tails = rows.join(bounds, within)
    top, bottom, w = F.col("score") >= F.col("_high"), F.col("score") <= F.col("_low"), F.col("weight")
    right = F.when(top & F.col("positive"), w).otherwise(0.0) + F.when(bottom & ~F.col("positive"), w).otherwise(0.0)
    called = F.when(top, w).otherwise(0.0) + F.when(bottom, w).otherwise(0.0)
    sums = tails.groupBy(*by).agg(F.sum(right).alias("_r"), F.sum(called).alias("_c"))
    return sums.select(*by, F.when(F.col("_c") > 0, F.col("_r") / F.col("_c")).alias(name))


def balanced_accuracy(rows: DataFrame, by: Sequence[str], threshold: float = 0.0, name: str = "balanced_accuracy") -> DataFrame:
    """Mean of both classes' recall; a score above the threshold predicts positive. Null if a class is absent."""
    says, is_p = F.col("score") > threshold, F.col("positive")
    recall = lambda a, b: F.avg(F.when(b, a.cast("double")))
    return rows.groupBy(*by).agg(((recall(says, is_p) + recall(~says, ~is_p)) / 2).alias(name))


def accuracy(rows: DataFrame, by: Sequence[str], threshold: float = 0.0, name: str = "accuracy") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(((F.col("score") > threshold) == F.col("positive")).cast("double")).alias(name))
