"""Lake, registries, histories, configuration, logs and streams."""

import io
import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators.bars import SnapshotConflict
from tickloom.schemas import BAR, SNAPSHOT
from tickloom.sources import config, history, logs
from tickloom.sources.lake import Lake
from tickloom.sources.registry import Lockbox, LockboxExhausted, Trials, new_trials
from tickloom.streaming import bars as streams

UTC = timezone.utc


def bars(spark, days=1, sym="s", close=1.0, start=datetime(2024, 1, 3, 23, 30)):
    rows = [(sym, start + timedelta(minutes=m), 1.0, 2.0, 0.5, close + m / 1000, 10.0, 3, 1.1) for m in range(0, 1440 * days, 30)]
    return spark.createDataFrame(rows, BAR)


def snap(lake, rows, fetch):
    return lake.write_snapshot(rows, series="TRADES", request_timezone="UTC", bar_size="1 min", fetch_ts=fetch)


def test_snapshots_are_known_by_content(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    assert lake.snapshots().count() == 0 and lake.manifests().count() == 0
    first = snap(lake, bars(spark), datetime(2024, 2, 1, tzinfo=UTC))
    assert snap(lake, bars(spark).orderBy(F.rand(1)), datetime(2024, 2, 2, tzinfo=UTC)) == first
    assert lake.snapshots().count() == 48 and lake.manifests().count() == 1
    other = snap(lake, bars(spark, close=5.0), datetime(2024, 2, 3, tzinfo=UTC))
    assert other != first and lake.snapshots("s", "TRADES").count() == 96 and lake.snapshots(ids=other).count() == 48
    assert lake.snapshots("x").count() == lake.snapshots(series="BID_ASK").count() == 0
    assert lake.snapshots().columns == SNAPSHOT.fieldNames()
    assert sorted(p.name for p in (tmp_path / "lake/raw_snapshots/sym=s").iterdir()) == ["date=2024-01-03", "date=2024-01-04"]
    with pytest.raises(ValueError):
        snap(lake, bars(spark).where("false"), None)


def test_layers_replace_dates_and_keep_others(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    rows = bars(spark, 3).withColumns({"session": F.lit("RTH"), "is_traded": F.lit(True), **{c: F.lit(False) for c in ("is_gap", "is_halt", "is_zero_volume", "is_price_anomaly")}})
    assert lake.read("validated_bars").count() == 0 and "is_halt" in lake.read("validated_bars").columns
    assert lake.write("validated_bars", rows) == 144
    lake.write("validated_bars", rows.where("to_date(ts) = '2024-01-04'").withColumn("close", F.lit(9.0)))
    back = lake.read("validated_bars", "s")
    assert back.count() == 144 and back.where("close = 9.0").count() == 48
    some = lake.read("validated_bars", first=date(2024, 1, 4), last=date(2024, 1, 4))
    assert some.count() == 48
    assert "PartitionFilters: [isnotnull(date" in some._jdf.queryExecution().toString()
    facts = lake.build("validated_bars", rows, "s", sources=["a"])
    assert facts["traded_count"] == 144 and lake.read_manifest("validated_bars", "s")["row_count"] == 144 and lake.read_manifest("labels", "s") is None
    assert lake.build("validated_bars", rows, "nobody") is None


def test_dataset_manifest_is_found_by_id(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    rows = bars(spark).select("sym", F.col("ts").alias("decision_ts"), F.lit(1).alias("label"))
    facts = lake.build("datasets", rows, "s", raw=["b", "a"], bar="1", feature="2", label="3", cost="4", git="5")
    assert lake.read_manifest_by_id(facts["dataset_id"])["sym"] == "s"


def test_registries(spark, tmp_path):
    trials = Trials(spark, f"file://{tmp_path}/trials")
    for h, auc in (("a", 0.5), ("b", 0.6), ("a", 0.9)):
        trials.register("d", h, "m", auc)
    assert trials.count("d") == 2 and trials.count("e") == 0 and [r["auc"] for r in trials.trials("d").collect()] == [0.5, 0.6]
    more = spark.createDataFrame([(datetime(2024, 1, i), "d", h, "m", 0.1) for i, h in ((2, "c"), (1, "c"), (3, "a"))], trials.schema)
    assert [r["registered_at"].day for r in new_trials(more, trials.rows()).collect()] == [1]
    box = Lockbox(spark, f"file://{tmp_path}/box")
    with pytest.raises(ValueError):
        box.touch("d", "sha", "  ")
    box.touch("d", "sha", "first")
    box.touch("d", "sha", "second")
    with pytest.raises(LockboxExhausted):
        box.touch("d", "sha", "third")
    assert box.count() == 2 and box.remaining() == 0


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_pacing():
    clock = Clock()
    pacer = history.Pacer(clock=clock, sleep=clock.sleep)
    assert sum(pacer.acquire() for _ in range(60)) == 0 and pacer.acquire() == 600
    clock = Clock()
    pacer = history.Pacer(3, 60, clock=clock, sleep=clock.sleep)
    pacer.acquire(2)
    clock.now = 40
    assert pacer.acquire(history.weight_of("BID_ASK")) == 20 and pacer.acquire() == 0
    with pytest.raises(ValueError):
        pacer.acquire(4)


def test_retries():
    calls, slept = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [1]

    assert history.with_retries(fails, sleep=slept.append) == [1] and slept == [2.0, 4.0]
    with pytest.raises(OSError):
        history.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, slept.append)


def test_walk_back_and_depth():
    t = [datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=i) for i in range(100)]
    chunk = lambda end: [("s", x, i) for i, x in enumerate(t) if end - timedelta(minutes=30) <= x < end]
    assert [r[1] for r in history.walk_back(chunk, t[10], t[90])] == t[10:90]
    assert history.walk_back(lambda end: [], t[0], t[9]) == []
    has = lambda a, b: next((x for x in t if a <= x < b), None)
    assert history.discover_depth(has, t[0] - timedelta(days=200), t[-1] + timedelta(days=1)) == t[0]
    assert history.discover_depth(lambda a, b: None, t[0], t[-1]) is None


def test_vendor_rows(spark):
    rows = spark.createDataFrame([("2024-07-03 09:30:00", 1.0, 1.0, 1.0, 1.0, 5.0, None, None)], "date string, open double, high double, low double, close double, volume double, bar_count bigint, wap double")
    got = history.neutral(rows.withColumn("date", F.to_timestamp("date")), F.lit("s"), "America/New_York").first()
    assert got["ts"] == datetime(2024, 7, 3, 13, 30) and (got["bar_count"], got["wap"]) == (-1, -1.0)
    assert history.utc(datetime(2024, 1, 3, 9, 30), "America/New_York") == datetime(2024, 1, 3, 14, 30, tzinfo=UTC)
    with pytest.raises(TypeError):
        history.utc("2024", "UTC")


def test_replay_source(spark, tmp_path):
    bars(spark, 5).write.parquet(str(tmp_path / "b"))
    spark.dataSource.register(history.ReplaySource)
    read = spark.read.format("bar_replay").options(path=str(tmp_path / "b"), symbols="s, none", start="2024-01-04", end="2024-01-06", window_days="1").load()
    assert read.count() == 96 and read.agg(F.min("ts")).first()[0] == datetime(2024, 1, 4)


class Recorded:
    def __init__(self):
        self.asked = []

    def fetch(self, sym, start, end, series):
        self.asked.append((start, end))
        first = start.replace(minute=0, second=0) + timedelta(hours=bool(start.minute))
        return [(sym, first + timedelta(hours=h), 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1.0) for h in range(0, 24 * 90) if first + timedelta(hours=h) < end]


def test_ingestion_goes_on_from_the_frontier(spark, tmp_path):
    lake, source = Lake(spark, f"file://{tmp_path}/lake"), Recorded()
    ingest = history.Ingestor(spark, lake, source)
    start, end = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 3, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        ingest.update("s", "TRADES", end)
    assert ingest.backfill("s", "TRADES", start, end) == 60 * 24 and len(source.asked) == 2
    assert ingest.complete("s", "TRADES", end) and not ingest.complete("s", "TRADES", end + timedelta(days=5))
    assert ingest.update("s", "TRADES", end + timedelta(hours=2)) == 3 and source.asked[-1][0] == end - timedelta(hours=1)


def sections():
    return {
        "symbols": {"tradable": ["A"], "context": ["B"]}, "sessions": {"ingest": ["PRE", "RTH"], "tradable": ["RTH"], "timezone": "America/New_York"},
        "bars": {"step": "1 minute", "series": ["TRADES"], "version": "1"}, "features": {"horizons": [1, 5], "range_window": 30, "volume_window": 60, "version": "1"},
        "volatility": {"bucket_minutes": 30, "span_days": 20}, "labels": {"method": "triple_barrier", "k": 2, "h_bars": 30, "version": "1"},
        "costs": {"impact_bps": 1, "commission_bps": 0.14, "fees_bps": 0.2, "version": "1"}, "source": {"units": 60, "seconds": 600, "request_timezone": "UTC"}, "storage": {"root": "/x"},
    }


def write(folder, values):
    for name, v in values.items():
        (folder / f"{name}.json").write_text(json.dumps(v))


def test_config(tmp_path):
    write(tmp_path, sections())
    c = config.load(tmp_path)
    assert c.labels.k == 2.0 and c.symbols.tradable == ("A",)


@pytest.mark.parametrize("name, key, value", [
    ("symbols", "context", ["A"]), ("sessions", "tradable", ["POST"]), ("sessions", "ingest", ["NIGHT"]), ("bars", "series", ["MID"]), ("labels", "method", "fixed_horizon_direction"),
    ("labels", "k", "two"), ("labels", "k", None), ("labels", "unknown", 1), ("labels", "h_bars", 0), ("labels", "h_bars", True),
])
def test_bad_config(tmp_path, name, key, value):
    values = sections()
    values[name][key] = value
    if value is None:
        del values[name][key]
    write(tmp_path, values)
    with pytest.raises(config.ConfigError, match=name):
        config.load(tmp_path)


def test_unreadable_config(tmp_path):
    write(tmp_path, sections())
    (tmp_path / "costs.json").write_text("{")
    with pytest.raises(config.ConfigError, match="costs.json"):
        config.load(tmp_path)
    (tmp_path / "costs.json").unlink()
    with pytest.raises(config.ConfigError, match="costs"):
        config.load(tmp_path)


def test_logs():
    out = io.StringIO()
    logs.configure("INFO", out)
    log = logs.get_logger("x", sym="s")
    log.debug("not seen")
    log.info("seen", context={"n": 3})
    (line,) = out.getvalue().splitlines()
    record = json.loads(line)
    assert (record["event"], record["level"], record["sym"], record["n"]) == ("seen", "info", "s", 3)


def delivery(spark, close, fetch, ident, start=datetime(2024, 1, 3, 10)):
    return bars(spark, close=close, start=start).withColumns({"series": F.lit("TRADES"), "snapshot_id": F.lit(ident), "fetch_ts": F.lit(fetch).cast("timestamp")})


def test_latest_wins_stream(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    source = tmp_path / "in"
    delivery(spark, 1.0, "2024-01-04 12:00:00", "a").write.parquet(str(source / "1"))
    schema = spark.read.parquet(str(source / "1")).schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    run = lambda: streams.ingest_stream(lake, stream(), f"{tmp_path}/cp").awaitTermination()
    run()
    live = lambda: spark.read.parquet(f"{tmp_path}/lake/live")
    assert live().count() == 48
    delivery(spark, 2.0, "2024-01-04 13:00:00", "b").where("hour(ts) = 12").write.parquet(str(source / "2"))
    run()
    assert live().count() == 48 and live().where("snapshot_id = 'b'").count() == 2
    streams.merge_batch(lake, delivery(spark, 2.0, "2024-01-04 13:00:00", "b").where("hour(ts) = 12"))
    assert live().count() == 48
    with pytest.raises(SnapshotConflict):
        streams.merge_batch(lake, delivery(spark, 3.0, "2024-02-01 00:00:00", "c"))


def test_streamed_bars_append(spark, tmp_path):
    ticks = spark.createDataFrame([("s", datetime(2024, 1, 3, 10, m % 60) + timedelta(hours=m // 60), m, float(m)) for m in range(0, 300, 3)], "sym string, ts timestamp, event_id bigint, price double")
    ticks.unionByName(ticks.limit(5)).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    made = streams.stream_ohlcv(stream, "15 minutes", "10 minutes")
    made.writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    closed = spark.table("closed").collect()
    assert 0 < len(closed) < 20 and all(r["open"] <= r["close"] for r in closed)
    unique = streams.deduplicated(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t")))
    unique.writeStream.format("memory").queryName("unique").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("unique").count() == 100


def test_commands_from_ingest_to_dataset(spark, tmp_path, capsys):
    from tickloom.__main__ import main
    from tickloom.operators.bars import bars_frame

    at, rows = datetime(2024, 1, 2, 14, 30, tzinfo=UTC), []
    for d in range(4):
        for m in range(60):
            close = 100 + (m * 7 + d * 3) % 11 / 10
            rows.append(("A", at + timedelta(days=d, minutes=m), close, close + 0.3, close - 0.3, close, 10.0 + m % 3, 2, close))
    with pytest.raises(ValueError):
        bars_frame(spark, [("A", datetime(2024, 1, 1), *rows[0][2:])])
    bars_frame(spark, rows).write.parquet(str(tmp_path / "bars"))
    values = sections()
    values["storage"]["root"], values["bars"]["series"] = f"file://{tmp_path}/lake", ["TRADES", "BID_ASK"]
    (tmp_path / "config").mkdir()
    write(tmp_path / "config", values)
    do = lambda command, *more: main([command, "--config", str(tmp_path / "config"), "--symbol", "A", *more], spark)
    span = ("--bars", str(tmp_path / "bars"), "--start", "2024-01-01", "--end", "2024-01-06")
    assert do("dataset", "--allow-dirty") == 2
    assert do("ingest", *span) == 0 and do("ingest", "--series", "BID_ASK", *span) == 0 and do("status", "--end", "2024-03-01") == 1
    assert do("validate") == do("features") == do("labels") == do("dataset", "--allow-dirty") == 0
    lake = Lake(spark, values["storage"]["root"])
    facts = lake.read_manifest("datasets", "A")
    data = lake.read("datasets", "A")
    assert facts["row_count"] == data.count() > 100 and {"ret_5b", "label", "minute_of_day"} <= set(data.columns)
    assert do("report") == 0 and "Evidence: A" in capsys.readouterr().out
