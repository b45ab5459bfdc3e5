"""The engine's queries, each over the driver's tables. Bars are 15-minute ones of the events, a symbol for each event type."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import minute_of_day, time_bucket
from tickloom.functions.identity import dataset_id_column
from tickloom.operators import bars as B
from tickloom.operators import features as X
from tickloom.operators import labels as L
from tickloom.operators import leakage, metrics, overfitting, quotes, splits
from tickloom.operators.calendar import calendar_for, tag_sessions
from tickloom.operators.study import CorrelationSign, Study
from tickloom.session import cut, shared_dir
from tickloom.sources import history, registry
from tickloom.sources.lake import Lake
from tickloom.streaming.bars import stream_ohlcv

STEP, H_BARS, SCOPE = "15 minutes", 30, ("PRE", "RTH", "POST")
#: Permutations of a seed, seeds, and the seed that the hash gets.
PERMUTATIONS, SEEDS, NULL_SEED = 4, 2, 5
STUDIED = ("ret_1b", "ret_5b", "range_vol", "rel_volume")
LAGGED = ("ret_1b", "ret_5b", "ret_15b", "ret_30b", "ewma_vol", "range_vol", "rel_volume")
FLAGS = ("minute_of_day", "is_pre", "is_rth", "is_post")


def text(*names: str) -> list[Column]:
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def rounded(*names: str, digits: int = 8) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def dates(spark: SparkSession, sf: str) -> tuple[date, date]:
    """The first and the last date of the events."""
    return tuple(events(spark, sf).agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first())


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.ohlcv(B.ticks_of(events(spark, sf)), STEP)


def days(spark: SparkSession, sf: str) -> DataFrame:
    return calendar_for(events(spark, sf))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return tag_sessions(bars(spark, sf), days(spark, sf)).withColumn("is_traded", F.lit(True))


def validated(spark: SparkSession, sf: str) -> DataFrame:
    rows = bars(spark, sf)
    return B.flag_quality(B.attach(B.session_grid(rows, days(spark, sf), SCOPE, STEP), rows))


def fetched(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries: all bars, and a day later those of even hours, some of them changed."""
    rows = bars(spark, sf).withColumn("series", F.lit("TRADES"))
    hour = F.hour("ts")
    later = rows.where(hour % 2 == 0).withColumns({"close": F.when(hour % 4 == 0, F.col("close") + 1).otherwise(F.col("close")), "bar_count": F.when(hour != 6, F.col("bar_count"))})
    stamp = lambda df, at, name: df.withColumns({"fetch_ts": F.lit(at).cast("timestamp"), "snapshot_id": F.lit(name)})
    return stamp(rows, "2024-02-05 00:00:00", "a").unionByName(stamp(later, "2024-02-06 00:00:00", "b"))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return X.build_features(tagged(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return L.TripleBarrier(2.0, H_BARS).generate(X.with_sigma(tagged(spark, sf)))


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Features and labels of one frame with sigma."""
    rows = cut(X.with_sigma(tagged(spark, sf)))
    return L.assemble_dataset(X.build_features(rows), L.TripleBarrier(2.0, H_BARS).generate(rows)).withColumn("bucket", F.floor(F.col("minute_of_day") / 30))


def studied(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset with features free of the last digits' noise, which would decide signs and ties."""
    return dataset(spark, sf).withColumns({c: F.round(c, 9) for c in STUDIED})


def weighed(spark: SparkSession, sf: str) -> DataFrame:
    return splits.uniqueness_weights(splits.indexed(dataset(spark, sf)))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved labels with a score: the lagged five-bar return."""
    rows = cut(weighed(spark, sf)).where("label <> 0")
    return rows.select("sym", "bucket", "weight", (F.col("label") > 0).alias("positive"), F.round(F.coalesce("ret_5b", F.lit(0.0)), 9).alias("score"))


def scratch(spark: SparkSession) -> str:
    """A new folder of the shared one that the session names."""
    return f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def bars_ohlcv(spark, sf):
    return bars(spark, sf).select("sym", *text("ts"), *rounded("open", "high", "low", "close", "volume", "wap"), "bar_count")


@query
def session_tagged(spark, sf):
    return tagged(spark, sf).select("sym", *text("ts"), "session", minute_of_day(F.col("ts")).alias("minute_of_day"), time_bucket(F.col("ts"), 30).alias("bucket"))


@query
def session_grid(spark, sf):
    rows = bars(spark, sf)
    return B.attach(B.session_grid(rows, days(spark, sf), SCOPE, STEP), rows).select("sym", *text("ts"), "session", "is_traded", *rounded("close"))


@query
def quality_flags(spark, sf):
    return validated(spark, sf).select("sym", *text("ts"), "session", "is_traded", "is_gap", "is_halt", "is_zero_volume", "is_price_anomaly")


@query
def latest_fetch_wins(spark, sf):
    return B.latest_fetch_wins(fetched(spark, sf)).select("sym", "series", *text("ts"), *rounded("close"), "bar_count", "snapshot_id")


@query
def snapshot_conflicts(spark, sf):
    return B.find_conflicts(fetched(spark, sf), datetime(2024, 1, 25)).select("sym", "series", *text("ts"), "close", "bar_count")


@query
def lagged_returns(spark, sf):
    return X.build_features(tagged(spark, sf), [X.LaggedReturns()]).select("sym", *text("ts"), *rounded("ret_1b", "ret_5b", "ret_15b", "ret_30b"))


@query
def parkinson_vol(spark, sf):
    return X.build_features(tagged(spark, sf), [X.RangeVolatility()]).select("sym", *text("ts"), *rounded("range_vol"))


@query
def relative_volume(spark, sf):
    return X.build_features(tagged(spark, sf), [X.RelativeVolume()]).select("sym", *text("ts"), *rounded("rel_volume", digits=6))


@query
def time_of_day(spark, sf):
    return X.build_features(tagged(spark, sf), [X.TimeOfDay()]).select("sym", *text("ts"), *FLAGS)


@query
def bucket_ewma_sigma(spark, sf):
    return X.with_sigma(tagged(spark, sf)).select("sym", *text("ts"), *rounded("sigma"))


@query
def feature_matrix(spark, sf):
    return featured(spark, sf).select("sym", *text("ts"), "session", *rounded(*LAGGED, digits=6), *FLAGS)


@query
def asof_context(spark, sf):
    """Every symbol's bars with the last symbol's as context."""
    rows = tagged(spark, sf)
    last = events(spark, sf).agg(F.max("event_type")).first()[0]
    made = X.build_features(rows, [X.ContextReturn("other")], context={"other": rows.where(F.col("sym") == last)})
    return made.select("sym", *text("ts", "ctx_ts"), *rounded("ctx_close"))


@query
def triple_barrier(spark, sf):
    return labelled(spark, sf).select("sym", *text("decision_ts", "entry_ts", "exit_ts"), "label", "touched", *rounded("gross_return", "sigma"))


@query
def label_distribution(spark, sf):
    return L.label_distribution(labelled(spark, sf)).select("sym", "label", "n", *rounded("mean_gross_return"))


@query
def research_dataset(spark, sf):
    return dataset(spark, sf).select("sym", *text("decision_ts", "entry_ts", "exit_ts"), "label", "touched", "session", *rounded("gross_return", *LAGGED, digits=6), *FLAGS)


@query
def barrier_stats(spark, sf):
    spread = quotes.with_spread(quotes.quotes_of(tagged(spark, sf))).where("session = 'RTH' and spread_bps >= 0").groupBy("sym").agg(F.median("spread_bps").alias("spread"))
    rows = L.barrier_stats(labelled(spark, sf)).join(spread, "sym").withColumn("cost_bps", quotes.round_trip_bps(F.col("spread")))
    even = {f"breakeven_{m}x": F.round(quotes.breakeven_accuracy(F.col("cost_bps"), F.col("barrier_bps"), m), 8) for m in (1, 2)}
    return rows.withColumns(even).select("sym", "n", *rounded("timeout_rate"), *rounded("barrier_bps", digits=5), *rounded("cross_day_rate"), *rounded("cost_bps", digits=6), *even)


@query
def decision_rules(spark, sf):
    """The pre-declared verdicts over a study's rank metric, a tail's accuracy and the costs' breakeven."""
    rows = barrier_stats(spark, sf).join(study_corr_sign(spark, sf).select("sym", "auc"), "sym").join(tail_accuracy(spark, sf), "sym")
    rows = rows.join(overfitting.null_summary(null_aucs(spark, sf)), "sym", "left")
    verdicts = quotes.decisions(rows, observed="auc", null_mean="null_mean", null_std="null_std", breakeven2="breakeven_2x", tail="tail_accuracy", breakeven1="breakeven_1x")
    return verdicts.select("sym", "beats_null", "tail_pays", "floor_holds")


@query
def spread_by_session(spark, sf):
    return quotes.spread_by_session(quotes.quotes_of(tagged(spark, sf))).select("sym", "session", "n", *rounded("mean_bps", "median_bps", "p25_bps", "p75_bps", "p95_bps", digits=6))


@query
def session_counts(spark, sf):
    return quotes.session_counts(tagged(spark, sf)).select("sym", "session", "n", *text("earliest"))


@query
def cpcv_membership(spark, sf):
    return splits.cpcv(splits.indexed(labelled(spark, sf)), 6, 2, h_bars=H_BARS).select("sym", "split", "i", "role")


@query
def uniqueness_weights(spark, sf):
    return splits.uniqueness_weights(splits.indexed(labelled(spark, sf))).select("sym", *text("decision_ts"), *rounded("weight"))


@query
def effective_sample_size(spark, sf):
    return splits.uniqueness_weights(splits.indexed(labelled(spark, sf))).groupBy("sym").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("effective_n"))


@query
def weighted_auc(spark, sf):
    return metrics.weighted_auc(ranked(spark, sf), ["sym"]).where("auc is not null").select("sym", *rounded("auc"))


@query
def plain_auc(spark, sf):
    return metrics.auc(ranked(spark, sf), ["sym"]).where("auc is not null").select("sym", *rounded("auc"))


@query
def conditional_auc(spark, sf):
    return metrics.conditional_auc(ranked(spark, sf), ["sym"], "bucket").where("auc is not null").select("sym", *rounded("auc"))


@query
def tail_accuracy(spark, sf):
    return metrics.tail_accuracy(ranked(spark, sf), ["sym"], 0.1).select("sym", *rounded("tail_accuracy"))


@query
def tail_accuracy_by_bucket(spark, sf):
    return metrics.tail_accuracy(ranked(spark, sf), ["sym"], 0.1, "bucket").select("sym", *rounded("tail_accuracy"))


@query
def balanced_accuracy(spark, sf):
    rows = cut(ranked(spark, sf))
    return metrics.balanced_accuracy(rows, ["sym"]).join(metrics.accuracy(rows, ["sym"]), "sym").select("sym", *rounded("balanced_accuracy", "accuracy"))


@query
def study_corr_sign(spark, sf):
    return Study(6, 2).run(studied(spark, sf), CorrelationSign(), STUDIED, H_BARS).select("sym", *rounded("auc", "balanced_accuracy", "accuracy"), "n_paths")


@query
def block_aucs(spark, sf):
    return Study().block_aucs(studied(spark, sf), CorrelationSign(), STUDIED, H_BARS, 4).select("sym", "block", *rounded("auc"))


@query
def deflated_prob(spark, sf):
    null = Study(6, 2).by_split(studied(spark, sf), CorrelationSign(), STUDIED, H_BARS).where("auc is not null")
    return overfitting.deflated_probability(null.withColumn("auc", F.round("auc", 9)), F.lit(0.52), 5).select(*rounded("probability"))


@query
def pbo_small(spark, sf):
    rows = splits.with_groups(splits.indexed(dataset(spark, sf)), 4)
    parts = F.explode(F.array(*[F.struct(F.lit(t).alias("trial"), (F.coalesce(c, F.lit(0.0)) * F.col("label")).alias("metric")) for t, c in enumerate(STUDIED)]))
    matrix = rows.select(F.col("g").alias("block"), parts.alias("p")).groupBy("p.trial", "block").agg(F.round(F.avg("p.metric"), 12).alias("metric"))
    return overfitting.pbo(matrix, 4).select(*rounded("pbo"), "n_splits")


def trial_rows(spark, sf) -> DataFrame:
    ident = F.substring(F.sha2(F.concat_ws("|", "event_type", (F.col("user_id") % 17).cast("string")), 256), 1, 16)
    return events(spark, sf).select(F.col("event_type").alias("dataset_id"), ident.alias("trial_hash"), F.col("ts").alias("registered_at"), "event_id")


@query
def trial_registry(spark, sf):
    return trial_rows(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("tries"), F.countDistinct("trial_hash").alias("trials"), F.min("trial_hash").alias("first_hash"))


@query
def registry_first_rows(spark, sf):
    return registry.distinct_trials(trial_rows(spark, sf)).select("dataset_id", "trial_hash", "event_id")


@query
def dataset_id(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("sym"), F.to_date("ts").cast("string").alias("d")).distinct()
    raw = F.collect_list(F.substring(F.sha2(F.concat("sym", "d"), 256), 1, 32))
    ident = dataset_id_column(F.col("raw"), F.lit("15m"), F.lit("f1"), F.lit("k2h30"), F.lit("c1"), F.col("sym"))
    return rows.groupBy("sym").agg(raw.alias("raw")).select("sym", ident.alias("dataset_id"))


@query
def pacing_budget(spark, sf):
    requests = events(spark, sf).select(F.col("event_type").alias("source"), "ts", "event_id", F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).cast("bigint").alias("weight"))
    return history.budget_used(requests).select("source", *text("ts"), "event_id", "weight", "used")


@query
def systematic_sample(spark, sf):
    """Every fifteenth row first, then those without nulls."""
    rows = splits.indexed(dataset(spark, sf).where(F.year("decision_ts").between(2021, 2025)))
    return rows.where("i % 15 = 0").dropna(subset=["ret_1b", "range_vol"]).select("sym", *text("decision_ts"), "label")


@query
def inner_fold(spark, sf):
    train = splits.cpcv(splits.indexed(labelled(spark, sf)), 6, 2, h_bars=H_BARS).where("role = 'train'")
    return splits.inner_fold(train, 0.2).groupBy("sym", "split", F.coalesce("fold", F.lit("purged")).alias("fold")).agg(F.count("*").alias("n"))


def null_aucs(spark, sf) -> DataFrame:
    """sym, b, auc of studies of permuted labels."""
    null = overfitting.permutation_null(Study(6, 2), studied(spark, sf), CorrelationSign(), STUDIED, H_BARS, PERMUTATIONS * SEEDS, seed=NULL_SEED)
    return null.withColumn("auc", F.round("auc", 9))


@query
def permutation_null(spark, sf):
    return null_aucs(spark, sf).select("sym", "b", *rounded("auc"))


@query
def auc_deflation(spark, sf):
    """The study's metric, deflated by the permutations of each seed for as many trials as there are features."""
    observed = study_corr_sign(spark, sf).select("sym", F.col("auc").alias("observed"))
    null = null_aucs(spark, sf).withColumn("seed", F.floor(F.col("b") / PERMUTATIONS)).join(observed, "sym")
    below = F.avg((F.round("auc", 8) <= F.col("observed")).cast("double"))
    by_seed = null.groupBy("sym", "seed").agg(F.pow(below, len(STUDIED)).alias("probability"))
    return quotes.deflation_verdict(by_seed, ["sym"]).select("sym", *rounded("mean", "spread"), "verdict")


@query
def ablation_shares(spark, sf):
    """What the calendar's features and the market's keep of the study's excess over chance."""
    rows = cut(dataset(spark, sf).withColumns({c: F.round(c, 9) for c in STUDIED}))
    def auc(name: str, features: tuple[str, ...]) -> DataFrame:
        return Study(6, 2).run(rows, CorrelationSign(), features, H_BARS).select("sym", F.round("auc", 8).alias(name))

    found = auc("full_auc", STUDIED + FLAGS).join(auc("calendar_auc", FLAGS), "sym").join(auc("market_auc", STUDIED), "sym")
    made = quotes.ablations(found, full="full_auc", calendar="calendar_auc", market="market_auc")
    return made.select("sym", "full_auc", "calendar_auc", "market_auc", *rounded("calendar_share", "market_share", digits=4), "verdict")


@query
def tail_accuracies(spark, sf):
    """Two tails of the study's scores, within buckets, over splits of ten resolved rows and more."""
    study = Study(6, 2, bucket="bucket")
    return study.tail_accuracies(studied(spark, sf), CorrelationSign(), STUDIED, H_BARS, (0.1, 0.25), within_bucket=True).select("sym", "quantile", *rounded("tail_accuracy"))


@query
def lockbox_touches(spark, sf):
    """Each event a touch of a dataset of its own type and user."""
    touches = events(spark, sf).select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("dataset_id"))
    return registry.touch_counts(touches)


@query
def new_trials(spark, sf):
    """Trials of the events that a registry of those before the middle of their dates lacks."""
    ident = F.substring(F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.hour("ts").cast("string")), 256), 1, 16)
    rows = events(spark, sf).select(F.col("event_type").alias("dataset_id"), ident.alias("trial_hash"), F.col("ts").alias("registered_at"))
    first, last = dates(spark, sf)
    middle = F.lit(first + (last - first) / 2)
    known = registry.distinct_trials(rows.where(F.to_date("registered_at") < middle))
    return registry.new_trials(rows.where(F.to_date("registered_at") >= middle), known).select("dataset_id", "trial_hash", *text("registered_at"))


@query
def shuffled_labels(spark, sf):
    return leakage.shuffle_labels(labelled(spark, sf), 11).select("sym", *text("decision_ts"), "label")


@query
def shuffled_label_blocks(spark, sf):
    return leakage.shuffle_label_blocks(labelled(spark, sf), 11, overfitting.block_bars(H_BARS, 1)).select("sym", *text("decision_ts"), "label")


@query
def label_shuffle(spark, sf):
    """Labels dealt anew: their counts stay."""
    return leakage.shuffle_labels(labelled(spark, sf), 11).groupBy("sym", "label").count()


@query
def label_block_shuffle(spark, sf):
    return leakage.shuffle_label_blocks(labelled(spark, sf), 11, overfitting.block_bars(H_BARS)).groupBy("sym", "label").count()


@query
def stream_bars(spark, sf):
    """The bars again, by a stream over the events: all that the watermark has closed, and at the end the rest."""
    source = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    at = scratch(spark)
    # the complete mode's result has all bars, closed or not
    made = stream_ohlcv(B.ticks_of(stream), STEP)
    run = made.writeStream.outputMode("complete").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/bars"))
    run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/bars").select("sym", *text("ts"), *rounded("open", "high", "low", "close", "volume", "wap"), "bar_count")


@query
def lake_round_trip(spark, sf):
    """Labels written to a lake and read back, a stretch of dates only."""
    lake = Lake(spark, scratch(spark))
    lake.write("labels", labelled(spark, sf))
    rows = lake.read("labels", first=datetime(2024, 1, 10).date(), last=datetime(2024, 1, 19).date())
    return rows.groupBy("sym", "label", "touched").agg(F.count("*").alias("n"), F.round(F.sum("gross_return"), 6).alias("total"))


@query
def replay_source(spark, sf):
    """A week of bars through the replay data source."""
    spark.dataSource.register(history.ReplaySource)
    at = f"{scratch(spark)}/bars"
    bars(spark, sf).write.parquet(at)
    names = ",".join(sorted(r[0] for r in events(spark, sf).select("event_type").distinct().collect()))
    read = spark.read.format("bar_replay").options(path=at, symbols=names, start="2024-01-05", end="2024-01-12", window_days="3").load()
    return read.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.sum("close"), 5).alias("total"))


@query
def vendor_times(spark, sf):
    """Naive local times as UTC: each event as a vendor's row."""
    price = {c: 100 + F.col("value") / 100 for c in ("open", "high", "low", "close")}
    rows = events(spark, sf).withColumns({**price, "volume": F.lit(1.0), "bar_count": F.lit(None), "wap": F.lit(None)})
    made = history.neutral(rows, F.col("event_id").cast("string"), "America/New_York", "ts")
    return made.select(F.col("sym").cast("bigint").alias("event_id"), *text("ts"))


@query
def lake_whole(spark, sf):
    """Labels written to a lake and read back, over all dates that the events have."""
    lake = Lake(spark, scratch(spark))
    lake.write("labels", labelled(spark, sf))
    first, last = dates(spark, sf)
    rows = lake.read("labels", first=first, last=last)
    return rows.groupBy("sym", "label", "touched").agg(F.count("*").alias("n"), F.round(F.sum("gross_return"), 6).alias("total"))


@query
def replay_whole(spark, sf):
    """All bars through the replay data source."""
    spark.dataSource.register(history.ReplaySource)
    at = f"{scratch(spark)}/bars"
    bars(spark, sf).write.parquet(at)
    names = ",".join(sorted(r[0] for r in events(spark, sf).select("event_type").distinct().collect()))
    first, last = dates(spark, sf)
    read = spark.read.format("bar_replay").options(path=at, symbols=names, start=str(first), end=str(last + timedelta(days=1)), window_days="3").load()
    return read.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.sum("close"), 5).alias("total"))


@query
def vendor_times_all(spark, sf):
    """Naive local times as UTC, of every event."""
    rows = events(spark, sf).select("event_id", F.to_utc_timestamp("ts", "America/New_York").alias("ts"))
    return rows.select("event_id", *text("ts"))


@query
def assembled(spark, sf):
    """Settled deliveries that agree, assembled into a validated frame."""
    rows = bars(spark, sf).withColumns({"series": F.lit("TRADES"), "fetch_ts": F.lit("2024-02-05").cast("timestamp"), "snapshot_id": F.lit("a")})
    twice = rows.unionByName(rows.where(F.hour("ts") % 2 == 0).withColumns({"fetch_ts": F.lit("2024-02-06").cast("timestamp"), "snapshot_id": F.lit("b")}))
    frame = B.assemble_validated(twice, days(spark, sf), SCOPE, STEP)
    counted = {n: F.sum(F.col(c).cast("int")).alias(n) for n, c in (("traded", "is_traded"), ("gaps", "is_gap"), ("halts", "is_halt"))}
    return frame.groupBy("sym", "session").agg(F.count("*").alias("n"), *counted.values())
