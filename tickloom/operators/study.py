"""Studies: models scored over purged splits, the only place where numbers are made."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import zero_if_undefined
from tickloom.functions.identity import trial_hash
from tickloom.operators import metrics
from tickloom.operators.leakage import assert_features_are_not_outcomes
from tickloom.operators.splits import cpcv, indexed, inner_fold, uniqueness_weights
from tickloom.session import cut


class Model(Protocol):
    """threshold: scores above it predict +1."""

    threshold: float

    def scores(self, members: DataFrame, features: Sequence[str]) -> DataFrame:
        """members: rows with split, role (train, test), fold, label, weight and the features; the test rows with score."""


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where a side doesn't vary; F.corr() then divides by zero, an error in ANSI mode."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


@dataclass(frozen=True)
class CorrelationSign:
    """Scores by the one feature that correlates most with the label, with its sign; of those equal to nine digits the first.

    Fitted on all training rows, timeouts included, without weights; what is undefined in a feature counts as 0.
    """

    threshold: float = 0.0

    def chosen(self, members: DataFrame, features: Sequence[str]) -> DataFrame:
        """sym, split, feature, corr."""
        x = {f: zero_if_undefined(F.col(f).cast("double")) for f in features}
        y = F.col("label").cast("double")
        train = members.where("role = 'train'")
        fitted = train.groupBy("sym", "split").agg(*[F.coalesce(F.nanvl(correlation(x[f], y), F.lit(0.0)), F.lit(0.0)).alias(f"_r{n}") for n, f in enumerate(features)])
        each = F.array(*[F.struct(F.round(F.abs(F.col(f"_r{n}")), 9).alias("size"), F.lit(-n).alias("rank"), F.lit(f).alias("feature"), F.col(f"_r{n}").alias("corr")) for n, f in enumerate(features)])
        return fitted.select("sym", "split", F.array_max(each).alias("_b")).select("sym", "split", "_b.feature", "_b.corr")

    def scores(self, members: DataFrame, features: Sequence[str]) -> DataFrame:
        best = self.chosen(members, features)
        value = reduce(lambda rest, f: F.when(F.col("feature") == f, zero_if_undefined(F.col(f).cast("double"))).otherwise(rest), features, F.lit(None).cast("double"))
        joined = members.where("role = 'test'").join(best, ["sym", "split"])
        return joined.withColumn("score", F.when(F.col("corr") >= 0, value).otherwise(-value)).drop("feature", "corr")


@dataclass(frozen=True)
class BoostedTrees:
    """Gradient-boosted trees on resolved rows: the probability of +1. Early stop on the inner fold.

    Splits are fitted one after another, each over all executors.
    """

    rounds: int = 50
    depth: int = 4
    step: float = 0.05
    seed: int = 7
    threshold: float = 0.5

    def scores(self, members: DataFrame, features: Sequence[str]) -> DataFrame:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        filled = members.withColumns({f"_x_{f}": zero_if_undefined(F.col(f).cast("double")) for f in features})
        vectors = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_x").transform(filled).withColumn("_y", (F.col("label") > 0).cast("double"))
        parts = []
        for r in members.select("sym", "split").distinct().orderBy("sym", "split").collect():
            mine = vectors.where((F.col("sym") == r["sym"]) & (F.col("split") == r["split"]))
            train = mine.where("role = 'train' and label <> 0 and fold is not null").withColumn("_v", F.col("fold") == "validation")
            model = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", validationIndicatorCol="_v", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step, seed=self.seed).fit(train)
            parts.append(model.transform(mine.where("role = 'test'")).withColumn("score", vector_to_array("probability")[1]))
        scored = reduce(DataFrame.unionByName, parts)
        return scored.select(*members.columns, "score")


@dataclass(frozen=True)
class TrialSpec:
    """A configuration's identity, but for the columns, which the study adds as it runs them."""

    dataset_id: str
    model_class: str
    hyperparameters: dict
    feature_spec_version: str
    label_spec_version: str

    def hash(self, features: Sequence[str]) -> str:
        return trial_hash(feature_columns=features, **vars(self))


class Study:
    def __init__(self, n_groups: int = 6, k: int = 2, embargo_pct: float = 0.01, *, trials=None, inner_frac: float | None = None, bucket: str | None = None):
        self.n_groups, self.k, self.embargo_pct, self.trials, self.inner_frac, self.bucket = n_groups, k, embargo_pct, trials, inner_frac, bucket

    def members(self, dataset: DataFrame, h_bars: int) -> DataFrame:
        """Rows by split and role, weighted; fold is the inner fold of training rows (inner without one)."""
        rows = uniqueness_weights(indexed(dataset))
        split = cpcv(rows, self.n_groups, self.k, h_bars=h_bars, embargo_pct=self.embargo_pct)
        if self.inner_frac is None:
            return split.withColumn("fold", F.when(F.col("role") == "train", "inner"))
        train = inner_fold(split.where("role = 'train'"), self.inner_frac)
        return train.unionByName(split.where("role = 'test'").withColumn("fold", F.lit(None).cast("string")))

    def scored(self, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, label: str = "label", least: int = 2) -> DataFrame:
        """Resolved test rows with score and positive, of splits with a training row and `least` such rows and more."""
        assert_features_are_not_outcomes(features)
        rows = dataset if label == "label" else dataset.withColumn("label", F.col(label))
        tests = cut(model.scores(cut(self.members(rows, h_bars)), features)).where("label <> 0").withColumn("positive", F.col("label") > 0)
        enough = tests.groupBy("sym", "split").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
        return cut(tests.join(enough.drop("_n"), ["sym", "split"]))

    def by_split(self, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, label: str = "label") -> DataFrame:
        """sym, split, auc, balanced_accuracy, accuracy, n."""
        by = ["sym", "split"]
        rows = self.scored(dataset, model, features, h_bars, label)
        rank = metrics.weighted_auc(rows, by) if self.bucket is None else metrics.conditional_auc(rows, by, self.bucket)
        n = rows.groupBy(*by).agg(F.count("*").alias("n"))
        return rank.join(metrics.balanced_accuracy(rows, by, model.threshold), by).join(metrics.accuracy(rows, by, model.threshold), by).join(n, by)

    def run(self, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, label: str = "label", trial: TrialSpec | None = None) -> DataFrame:
        """sym, auc, balanced_accuracy, accuracy (means over splits) and n_paths; registers the trial if there is a store."""
        out = self.by_split(dataset, model, features, h_bars, label).groupBy("sym").agg(
            F.avg("auc").alias("auc"), F.avg("balanced_accuracy").alias("balanced_accuracy"), F.avg("accuracy").alias("accuracy"), F.count("*").alias("n_paths")
        )
        if self.trials is not None and trial is not None:
            for r in out.collect():  # a row a symbol
                self.trials.register(trial.dataset_id, trial.hash(features), trial.model_class, r["auc"], datetime.now(timezone.utc))
        return out

    def tail_accuracies(self, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, quantiles: Sequence[float], within_bucket: bool = False, trial: TrialSpec | None = None) -> DataFrame:
        """sym, quantile, tail_accuracy: means over splits of ten resolved rows and more."""
        rows = self.scored(dataset, model, features, h_bars, least=10)
        bucket = self.bucket if within_bucket else None
        parts = [metrics.tail_accuracy(rows, ["sym", "split"], q, bucket).withColumn("quantile", F.lit(float(q))) for q in quantiles]
        out = reduce(DataFrame.unionByName, parts).groupBy("sym", "quantile").agg(F.avg("tail_accuracy").alias("tail_accuracy"))
        if self.trials is not None and trial is not None:
            self.trials.register(trial.dataset_id, trial.hash(features), trial.model_class, float("nan"), datetime.now(timezone.utc))
        return out

    def block_aucs(self, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, n_blocks: int) -> DataFrame:
        """sym, block, auc: each of n_blocks blocks scored by what its purged rest trains; null where that can't be done."""
        single = Study(n_blocks, 1, self.embargo_pct, inner_frac=self.inner_frac)
        found = metrics.weighted_auc(single.scored(dataset, model, features, h_bars), ["sym", "split"])
        every = dataset.select("sym").distinct().withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        return every.join(found, ["sym", "split"], "left").select("sym", F.col("split").cast("int").alias("block"), "auc")

    def evaluate_lockbox(self, lockbox, dataset: DataFrame, model: Model, features: Sequence[str], h_bars: int, *, dataset_id: str, git_sha: str, justification: str) -> DataFrame:
        """The touch is recorded before anything is scored."""
        lockbox.touch(dataset_id, git_sha, justification)
        return self.run(dataset, model, features, h_bars)
