"""Queries beside the pruned ones that read every event, whatever its id and date."""

from pyspark.sql import functions as F

from tickloom.plans.queries import QUERIES


def test_every_event_gets_its_time(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert QUERIES["vendor_times_all"](spark, sf).count() == events.count()


def test_lake_and_replay_read_events_of_other_dates(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    later = events.withColumn("ts", (F.col("ts") + F.expr("interval 400 days")).cast(events.schema["ts"].dataType))
    later.write.parquet(f"{tmp_path}/events.parquet")
    for name, total in (("lake_whole", None), ("replay_whole", QUERIES["bars_ohlcv"](spark, str(tmp_path)).count())):
        n = QUERIES[name](spark, str(tmp_path)).agg(F.sum("n")).first()[0]
        assert n == total if total else n > 0
