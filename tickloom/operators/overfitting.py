"""How likely a result is luck: backtest overfitting over block halves, and deflation by the best of many trials."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.leakage import shuffle_label_blocks, shuffle_labels
from tickloom.operators.study import Model, Study

MOST_SPLITS = 20_000


def halves(n_blocks: int, most: int = MOST_SPLITS, seed: int = 0) -> list[tuple[int, ...]]:
    """In-sample halves: all of them, or a sample if there are more than `most`."""
    half = n_blocks // 2
    if math.comb(n_blocks, half) <= most:
        return list(combinations(range(n_blocks), half))
    rng = random.Random(seed)
    return [tuple(sorted(rng.sample(range(n_blocks), half))) for _ in range(most)]


def pbo(matrix: DataFrame, n_blocks: int, *, most: int = MOST_SPLITS, seed: int = 0) -> DataFrame:
    """pbo, n_splits of a matrix (trial, block from 0, metric): the share of halves whose best trial ranks no better than the
    median in the other half. Null for fewer than two trials or an odd number of blocks."""
    spark = matrix.sparkSession
    n_trials = matrix.select("trial").distinct().count()
    if n_trials < 2 or n_blocks < 2 or n_blocks % 2:
        return spark.createDataFrame([(None, 0)], "pbo double, n_splits bigint")
    chosen = halves(n_blocks, most, seed)
    splits = spark.createDataFrame([(i, list(h)) for i, h in enumerate(chosen)], "split int, inside array<int>")
    # a trial is one row with all its blocks, and then as many as there are splits, `most` at the most
    each = matrix.groupBy("trial").agg(F.collect_list(F.struct("block", "metric")).alias("blocks"))
    placed = each.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1)))).join(F.broadcast(splits), "split")
    mean = lambda keep: F.aggregate(
        F.filter("blocks", lambda b: b["metric"].isNotNull() & keep(b)), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, b: F.struct((a["s"] + b["metric"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]),
    )
    inside = lambda b: F.array_contains(F.col("inside"), b["block"].cast("int"))
    both = placed.select("split", "trial", mean(inside).alias("ins"), mean(lambda b: ~inside(b)).alias("out"))
    best = both.groupBy("split").agg(F.max_by(F.struct("trial", "out"), F.struct("ins", -F.col("trial"))).alias("b"))
    ranked = both.join(best, "split").groupBy("split").agg(
        (F.sum((F.col("out") < F.col("b.out")).cast("int")) + (F.sum((F.col("out") == F.col("b.out")).cast("int")) + 1) / 2).alias("rank")
    )
    return ranked.agg(F.avg((F.col("rank") / (n_trials + 1) <= 0.5).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))


def deflated_probability(null: DataFrame, observed: Column, n_trials: int, name: str = "probability") -> DataFrame:
    """Of null(auc): the share that is no larger than observed, to the power of the number of trials. Null if it is empty."""
    return null.agg(F.pow(F.avg((F.col("auc") <= observed).cast("double")), n_trials).alias(name))


def block_bars(h_bars: int, multiple: int = 10) -> int:
    """Blocks must outlast the labels' autocorrelation, which the horizon sets."""
    return multiple * h_bars


def permutations(dataset: DataFrame, n: int, seed: int = 0, block: int | None = None) -> DataFrame:
    """The dataset n times over, each time with the labels dealt anew; a copy's symbol is sym#b."""
    each = dataset.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    each = each.withColumn("sym", F.concat_ws("#", "sym", F.col("_b").cast("string"))).drop("_b")
    return shuffle_labels(each, seed) if block is None else shuffle_label_blocks(each, seed, block)


def permutation_null(study: Study, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, n: int, *, seed: int = 0, block: int | None = None) -> DataFrame:
    """sym, b, auc of a study of each of n permutations; undefined ones are left out. All are one relation and one study."""
    found = study.run(permutations(dataset, n, seed, block), model, features, h_bars)
    at = F.length(F.substring_index("sym", "#", -1))
    sym, b = F.expr("left(sym, length(sym) - _at - 1)"), F.substring_index("sym", "#", -1).cast("int")
    return found.withColumn("_at", at).select(sym.alias("sym"), b.alias("b"), "auc").where("auc is not null")


def auc_deflation(study: Study, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, *, observed: float, n_trials: int, n: int = 200, block: int | None = None, seed: int = 0) -> DataFrame:
    return deflated_probability(permutation_null(study, dataset, model, features, h_bars, n, seed=seed, block=block), F.lit(observed), n_trials)


def null_summary(null: DataFrame) -> DataFrame:
    """sym, null_mean, null_std, n of permutation_null's rows."""
    return null.groupBy("sym").agg(F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_std"), F.count("*").alias("n"))


def average_rank(rows: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank, equal values sharing the mean of theirs."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2.0)
