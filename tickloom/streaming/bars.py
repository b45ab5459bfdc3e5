"""Structured Streaming counterparts: bars from an event stream, and latest-wins ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tickloom.operators.bars import SETTLING, SnapshotConflict, find_conflicts, latest_fetch_wins, ohlcv
from tickloom.sources.lake import Lake


def stream_ohlcv(ticks: DataFrame, step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling bars of a tick stream; a bar is out when the watermark passes its end."""
    return ohlcv(ticks.withWatermark("ts", late), step)


def deduplicated(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events delivered twice within the watermark count once."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sym", "event_id"])


def merge_batch(lake: Lake, batch: DataFrame, layer: str = "live") -> None:
    """A delivery (bars with series, snapshot_id, fetch_ts) into a layer: the latest fetch of a bar stays.

    A bar older than two days before the newest fetch is settled; one that differs from what is there raises. The same
    delivery twice changes nothing.
    """
    at = f"{lake.root}/{layer}"
    batch = batch.persist()
    try:
        if not batch.limit(1).count():
            return
        dates = [r[0] for r in batch.select(F.to_date("ts")).distinct().collect()]
        rows = batch
        if lake._there(at):
            there = lake.spark.read.schema(StructType([*batch.schema.fields]).add("date", "date")).parquet(at).where(F.col("date").isin(dates)).drop("date")
            rows = batch.unionByName(there)
        newest = rows.agg(F.max("fetch_ts")).first()[0]
        conflicts = find_conflicts(rows, newest - SETTLING)
        if n := conflicts.count():
            raise SnapshotConflict(f"{n} settled bars differ from what was delivered before")
        # what is overwritten is also read: the merged dates are written aside first
        merged = latest_fetch_wins(rows).select(*batch.columns).withColumn("date", F.to_date("ts"))
        aside = f"{lake.root}/_{layer}_next"
        merged.write.mode("overwrite").parquet(aside)
        lake.spark.read.parquet(aside).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(at)
    finally:
        batch.unpersist()


def ingest_stream(lake: Lake, deliveries: DataFrame, checkpoint: str, layer: str = "live", once: bool = True) -> StreamingQuery:
    """Runs merge_batch() over a stream of deliveries; once: until what is there now is in."""
    writer = deliveries.writeStream.foreachBatch(lambda batch, _: merge_batch(lake, batch, layer)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
