"""The lake: immutable snapshots by content id, and derived layers by symbol and UTC date.

    <root>/raw_snapshots/sym=S/date=D/    <root>/manifests/raw/    <root>/<layer>/sym=S/date=D/    <root>/manifests/<layer>/
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions.identity import dataset_id, snapshot_ids
from tickloom.schemas import LABELS, MANIFEST, SNAPSHOT, VALIDATED

KEY_OF = {"validated_bars": "ts", "features": "ts", "labels": "decision_ts", "datasets": "decision_ts"}
DECLARED = {"validated_bars": VALIDATED, "labels": LABELS}


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    # snapshots

    def write_snapshot(self, bars: DataFrame, *, series: str, request_timezone: str, bar_size: str, fetch_ts: datetime | None = None) -> list[str]:
        """Ids of the symbols' snapshots. Content that is there already is not written again; no bars are an error."""
        fetch_ts = fetch_ts or datetime.now(timezone.utc)
        keyed = bars.withColumns({"series": F.lit(series), "request_timezone": F.lit(request_timezone), "bar_size": F.lit(bar_size)})
        ids = snapshot_ids(keyed)
        spans = keyed.groupBy("sym").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("row_count"))
        manifest = ids.join(spans, "sym").withColumns({"fetch_ts": F.lit(fetch_ts), "files": F.array(F.concat(F.lit("raw_snapshots/sym="), F.col("sym")))})
        rows = manifest.select(*MANIFEST.fieldNames()).collect()  # a row a symbol
        if not rows:
            raise ValueError("a snapshot needs bars")
        known = {r["snapshot_id"] for r in self.manifests().where(F.col("snapshot_id").isin([r["snapshot_id"] for r in rows])).collect()}
        new = [r for r in rows if r["snapshot_id"] not in known]
        if new:
            fresh = self.spark.createDataFrame([(r["sym"], r["snapshot_id"]) for r in new], "sym string, snapshot_id string")
            out = bars.join(F.broadcast(fresh), "sym").withColumns({"series": F.lit(series), "fetch_ts": F.lit(fetch_ts), "date": F.to_date("ts")})
            out.select(*SNAPSHOT.fieldNames(), "date").write.mode("append").partitionBy("sym", "date").parquet(f"{self.root}/raw_snapshots")
            self.spark.createDataFrame(new, MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/manifests/raw")
        return [r["snapshot_id"] for r in rows]

    def manifests(self) -> DataFrame:
        """Of snapshots, by fetch time."""
        at = f"{self.root}/manifests/raw"
        found = self.spark.read.schema(MANIFEST).json(at) if self._there(at) else self.spark.createDataFrame([], MANIFEST)
        return found.orderBy("fetch_ts", "snapshot_id")

    def snapshots(self, sym: str | None = None, series: str | None = None, ids: Sequence[str] | None = None) -> DataFrame:
        at = f"{self.root}/raw_snapshots"
        if not self._there(at):
            return self.spark.createDataFrame([], SNAPSHOT)
        rows = self.spark.read.schema(StructType([*SNAPSHOT.fields]).add("date", "date")).parquet(at).drop("date")
        for condition in (sym and F.col("sym") == sym, series and F.col("series") == series, ids is not None and F.col("snapshot_id").isin(list(ids or []))):
            if condition is not None and condition is not False and not isinstance(condition, str):
                rows = rows.where(condition)
        return rows.select(*SNAPSHOT.fieldNames())

    # derived layers

    def write(self, layer: str, rows: DataFrame) -> int:
        """Replaces the dates that rows have, and leaves others; the number of rows written."""
        key = KEY_OF[layer]
        dated = rows.withColumn("date", F.to_date(key)).repartition("sym", "date").sortWithinPartitions("sym", key)
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sym", "date").parquet(f"{self.root}/{layer}")
        return rows.count()

    def read(self, layer: str, sym: str | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
        """Files outside the symbol and dates aren't read. A layer that isn't there is an empty frame with its schema."""
        at = f"{self.root}/{layer}"
        if not self._there(at):
            return self.spark.createDataFrame([], DECLARED.get(layer, StructType().add("sym", "string").add(KEY_OF[layer], "timestamp")))
        rows = self.spark.read.parquet(at).withColumn("sym", F.col("sym").cast("string"))
        if sym is not None:
            rows = rows.where(F.col("sym") == sym)
        if first is not None or last is not None:
            rows = rows.where(F.col("date").between(F.lit(first or date.min), F.lit(last or date.max)))
        rows = rows.drop("date")
        return rows.select(*DECLARED[layer].fieldNames()) if layer in DECLARED else rows

    def write_manifest(self, layer: str, sym: str, facts: dict) -> None:
        text = json.dumps(facts | {"sym": sym}, sort_keys=True, default=str)
        names = [f"{layer}/{sym}"] + ([f"datasets-by-id/{facts['dataset_id']}"] if layer == "datasets" else [])
        for name in names:
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifests/{name}")

    def read_manifest(self, layer: str, sym: str) -> dict | None:
        return self._json(f"{layer}/{sym}")

    def read_manifest_by_id(self, ident: str) -> dict | None:
        return self._json(f"datasets-by-id/{ident}")

    def _json(self, name: str) -> dict | None:
        at = f"{self.root}/manifests/{name}"
        return json.loads(self.spark.read.text(at).first()[0]) if self._there(at) else None

    def build(self, layer: str, rows: DataFrame, sym: str, **facts) -> dict | None:
        """Writes a symbol's rows and their manifest: row counts, traded rows or the labels' distribution, spec versions."""
        mine = rows.where(F.col("sym") == sym)
        n = self.write(layer, mine)
        if not n:
            return None
        manifest = {"row_count": n, "built_at": datetime.now(timezone.utc), **facts}
        if "is_traded" in rows.columns and layer != "datasets":
            manifest["traded_count"] = mine.where("is_traded").count()
        if layer == "labels":
            manifest["label_distribution"] = {str(r["label"]): r["count"] for r in mine.groupBy("label").count().collect()}
        if layer == "datasets":
            manifest["dataset_id"] = dataset_id(**{k: facts[k] for k in ("raw", "bar", "feature", "label", "cost", "git")})
        self.write_manifest(layer, sym, manifest)
        return manifest
