"""Append-only registries: trials that were scored, and touches of the lockbox.

Parquet has no constraints, so the writer holds them: a trial counts once for a dataset, a touch needs a reason.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.schemas import TOUCHES, TRIALS

LOCKBOX_TOUCHES = 2


class TrialStore(Protocol):
    def register(self, dataset_id: str, trial_hash: str, model_class: str, auc: float | None, at: datetime) -> None: ...
    def count(self, dataset_id: str) -> int: ...


class LockboxExhausted(RuntimeError):
    """No touch is left."""


class _Table:
    schema: StructType

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], self.schema).write.parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @contextmanager
    def _alone(self, patience: float = 60.0) -> Iterator[None]:
        """One writer at a time checks and appends: whoever creates the lock file, in any file system that creates atomically."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}.lock")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        until = time.monotonic() + patience
        while True:
            try:
                fs.create(at, False).close()
                break
            except Exception as e:
                if time.monotonic() > until or not fs.exists(at) and "AlreadyExists" not in str(e):
                    raise
                time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(at, False)

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], self.schema).coalesce(1).write.mode("append").parquet(self.path)


def new_trials(trials: DataFrame, registered: DataFrame) -> DataFrame:
    """Those that the registry lacks, one for each dataset and hash, the earliest."""
    first = Window.partitionBy("dataset_id", "trial_hash").orderBy("registered_at")
    once = trials.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.join(registered.select("dataset_id", "trial_hash"), ["dataset_id", "trial_hash"], "left_anti")


def distinct_trials(registered: DataFrame) -> DataFrame:
    """The earliest row of each trial of each dataset."""
    rest = [c for c in registered.columns if c not in ("dataset_id", "trial_hash")]
    return registered.groupBy("dataset_id", "trial_hash").agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("r")).select("dataset_id", "trial_hash", "r.*")


class Trials(_Table):
    schema = TRIALS

    def register(self, dataset_id: str, trial_hash: str, model_class: str, auc: float | None, at: datetime | None = None) -> None:
        with self._alone():
            there = self.rows().where((F.col("dataset_id") == dataset_id) & (F.col("trial_hash") == trial_hash))
            if not there.limit(1).count():
                self._append((at or datetime.now(timezone.utc), dataset_id, trial_hash, model_class, auc))

    def count(self, dataset_id: str) -> int:
        return self.rows().where(F.col("dataset_id") == dataset_id).agg(F.countDistinct("trial_hash")).first()[0]

    def trials(self, dataset_id: str) -> DataFrame:
        return distinct_trials(self.rows().where(F.col("dataset_id") == dataset_id)).orderBy("trial_hash")


class LockboxStore(Protocol):
    """Touches are appended and read; none is changed or removed."""

    def touch(self, dataset_id: str, git_sha: str, justification: str) -> None: ...
    def count(self, dataset_id: str) -> int: ...
    def touches(self, dataset_id: str) -> DataFrame: ...


def touch_counts(touches: DataFrame, limit: int = LOCKBOX_TOUCHES) -> DataFrame:
    """dataset_id, touches, remaining, burned of every dataset that was touched."""
    counted = touches.groupBy("dataset_id").agg(F.count("*").alias("touches"))
    left = F.greatest(F.lit(limit) - F.col("touches"), F.lit(0))
    return counted.select("dataset_id", "touches", left.cast("bigint").alias("remaining"), (left == 0).alias("burned"))


class Lockbox(_Table):
    """Each dataset may be touched LOCKBOX_TOUCHES times."""

    schema = TOUCHES

    def touches(self, dataset_id: str) -> DataFrame:
        """Of a dataset, in order."""
        return self.rows().where(F.col("dataset_id") == dataset_id).orderBy("touched_at")

    def count(self, dataset_id: str | None = None) -> int:
        """Of a dataset, or of all."""
        return (self.rows() if dataset_id is None else self.touches(dataset_id)).count()

    def remaining(self, dataset_id: str | None = None) -> int:
        """Of a dataset, or of that which was touched most."""
        rows = self.rows() if dataset_id is None else self.touches(dataset_id)
        return touch_counts(rows).agg(F.coalesce(F.min("remaining"), F.lit(LOCKBOX_TOUCHES))).first()[0]

    def touch(self, dataset_id: str, git_sha: str, justification: str) -> None:
        reason = justification.strip()
        if not reason:
            raise ValueError("a touch needs a justification")
        with self._alone():
            if not self.remaining(dataset_id):
                raise LockboxExhausted(f"all {LOCKBOX_TOUCHES} touches of {dataset_id} are spent")
            self._append((datetime.now(timezone.utc), dataset_id, git_sha, reason))
