"""Content hashes that identify snapshots, datasets and trials."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import VALUES


def row_text(columns: Sequence[str] = ("ts", *VALUES)) -> Column:
    """A bar's canonical text: epoch microseconds and the values' shortest decimal forms."""
    parts = [F.unix_micros(F.col(c)).cast("string") if c == "ts" else F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.concat_ws("|", *parts)


def snapshot_ids(bars: DataFrame, keys: Sequence[str] = ("sym", "series", "request_timezone", "bar_size")) -> DataFrame:
    """keys, snapshot_id: 32 hex digits of the bars' content; when they were fetched is no part of it.

    A day's bars are hashed in order, then the days' digests, so no task gathers more than a day or a series' days.
    """
    day = bars.withColumn("_day", F.to_date("ts")).groupBy(*keys, "_day").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", row_text().alias("t")))), lambda r: r["t"]), "\n"), 256).alias("_digest")
    )
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_day", "_digest"))), lambda d: d["_digest"]), "\n")
    head = F.concat_ws("\x1f", *[F.col(k) for k in keys])
    return day.groupBy(*keys).agg(digests.alias("_all")).select(*keys, F.substring(F.sha2(F.concat(head, F.lit("\n"), F.col("_all")), 256), 1, 32).alias("snapshot_id"))


def dataset_id_column(raw: Column, bar: Column, feature: Column, label: Column, cost: Column, git: Column) -> Column:
    """raw: array of snapshot ids, in any order."""
    lines = [
        F.concat(F.lit("raw:"), F.array_join(F.array_sort(raw), ",")), F.concat(F.lit("bar:"), bar), F.concat(F.lit("feature:"), feature),
        F.concat(F.lit("label:"), label), F.concat(F.lit("cost:"), cost), F.concat(F.lit("git:"), git),
    ]
    return F.substring(F.sha2(F.concat_ws("\n", *lines), 256), 1, 16)


def dataset_id(*, raw: Sequence[str], bar: str, feature: str, label: str, cost: str, git: str) -> str:
    named = {"raw": ",".join(sorted(raw)), "bar": bar, "feature": feature, "label": label, "cost": cost, "git": git}
    return hashlib.sha256("\n".join(f"{k}:{v}" for k, v in named.items()).encode()).hexdigest()[:16]


def trial_hash(*, dataset_id: str, model_class: str, hyperparameters: Mapping[str, object], feature_columns: Sequence[str], feature_spec_version: str, label_spec_version: str) -> str:
    """Differs if anything differs that can change a score; the order of columns cannot."""
    identity = dict(locals()) | {"feature_columns": sorted(feature_columns)}
    return hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()[:16]


def git_sha(folder: str = ".") -> str:
    """HEAD's hash, with -dirty if tracked files have changed; unknown outside a repository."""
    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD") + ("-dirty" if git("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return "unknown"
