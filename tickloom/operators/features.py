"""Point-in-time features: generators of columns over the traded series, and one mandatory lag.

Windows start anew each session date, so a task holds one symbol's day. Generators return expressions over one frame
instead of frames to join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import ewma, log_or_null, minute_of_day, ratio, session_date, time_bucket
from tickloom.operators.ordered import asof_backward
from tickloom.schemas import TIMEZONE

#: The day's rows of a symbol, in order.
DAY: Sequence[str] = ("sym", "_sd")


def day_window() -> WindowSpec:
    return Window.partitionBy(*DAY).orderBy("ts")


@runtime_checkable
class FeatureGenerator(Protocol):
    """Columns over the traded bars of a day. deterministic: known before the bar, hence not lagged."""

    name: str
    deterministic: bool

    def columns(self) -> dict[str, Column]: ...


@runtime_checkable
class ContextGenerator(Protocol):
    """Columns that also use context symbols' bars, each a struct column, null where there is none yet."""

    name: str
    deterministic: bool

    def columns_with(self, context: Mapping[str, Column]) -> dict[str, Column]: ...


@dataclass(frozen=True)
class LaggedReturns:
    horizons: Sequence[int] = (1, 5, 15, 30)
    name: str = "lagged_returns"
    deterministic: bool = False

    def columns(self) -> dict[str, Column]:
        log = log_or_null(F.col("close"))
        return {f"ret_{h}b": log - F.lag(log, h).over(day_window()) for h in self.horizons}


@dataclass(frozen=True)
class RangeVolatility:
    """Parkinson's estimator over the last bars of the day."""

    window: int = 30
    name: str = "range_vol"
    deterministic: bool = False

    def columns(self) -> dict[str, Column]:
        squared = F.when((F.col("high") > 0) & (F.col("low") > 0), F.pow(F.ln(F.col("high") / F.col("low")), 2))
        return {"range_vol": F.sqrt(F.avg(squared).over(day_window().rowsBetween(1 - self.window, 0)) / (4 * F.ln(F.lit(2.0))))}


@dataclass(frozen=True)
class RelativeVolume:
    """Z-score of the volume among the day's last ones, itself included."""

    window: int = 60
    name: str = "rel_volume"
    deterministic: bool = False

    def columns(self) -> dict[str, Column]:
        recent = day_window().rowsBetween(1 - self.window, 0)
        mean, sd, n = F.avg("volume").over(recent), F.stddev_samp("volume").over(recent), F.count("volume").over(recent)
        return {"rel_volume": F.when((n >= 2) & (sd > 0), ratio(F.col("volume") - mean, sd))}


@dataclass(frozen=True)
class BarrierVolatility:
    """sigma, joined beforehand by with_sigma()."""

    name: str = "ewma_vol"
    deterministic: bool = False

    def columns(self) -> dict[str, Column]:
        return {"ewma_vol": F.col("sigma")}


@dataclass(frozen=True)
class TimeOfDay:
    tz: str = TIMEZONE
    name: str = "time_of_day"
    deterministic: bool = True

    def columns(self) -> dict[str, Column]:
        flags = {f"is_{s.lower()}": (F.col("session") == s).cast("bigint") for s in ("PRE", "RTH", "POST")}
        return {"minute_of_day": minute_of_day(F.col("ts"), self.tz)} | flags


@dataclass(frozen=True)
class ContextReturn:
    """A context symbol's last bar as of each row: its close and its time."""

    symbol: str
    name: str = "context_return"
    deterministic: bool = False
    prefix: str = field(default="ctx")

    def columns_with(self, context: Mapping[str, Column]) -> dict[str, Column]:
        return {f"{self.prefix}_close": context[self.symbol]["close"], f"{self.prefix}_ts": context[self.symbol]["ctx_ts"]}


DEFAULT_GENERATORS: tuple = (LaggedReturns(), BarrierVolatility(), RangeVolatility(), RelativeVolume(), TimeOfDay())


def traded(bars: DataFrame, tz: str = TIMEZONE) -> DataFrame:
    rows = bars.where("is_traded") if "is_traded" in bars.columns else bars
    return rows.withColumn("_sd", session_date(F.col("ts"), tz))


def barrier_volatility(bars: DataFrame, *, bucket_minutes: int = 30, span_days: int = 20, tz: str = TIMEZONE) -> DataFrame:
    """sym, session date, time bucket, sigma: by bucket, the root of the exponentially weighted mean of past days' realised
    variances; null on a bucket's first day, and after a day without one."""
    rows = traded(bars, tz).withColumn("_bucket", time_bucket(F.col("ts"), bucket_minutes, tz))
    log = log_or_null(F.col("close"))
    squared = rows.withColumn("_r2", F.pow(log - F.lag(log).over(day_window()), 2))
    daily = squared.groupBy("sym", "_sd", "_bucket").agg(F.avg("_r2").alias("_rv"))
    days = Window.partitionBy("sym", "_bucket").orderBy("_sd")
    # at a span of 20 days, 400 days' weights beyond this frame sum to under 1e-17
    past = F.collect_list("_rv").over(days.rowsBetween(-20 * span_days, 0))
    smooth = daily.withColumn("_ewma", F.when(F.col("_rv").isNotNull(), ewma(past, span_days)))
    return smooth.select("sym", "_sd", "_bucket", F.sqrt(F.lag("_ewma").over(days)).alias("sigma"))


def with_sigma(bars: DataFrame, *, bucket_minutes: int = 30, span_days: int = 20, tz: str = TIMEZONE) -> DataFrame:
    """The traded bars with sigma."""
    daily = barrier_volatility(bars, bucket_minutes=bucket_minutes, span_days=span_days, tz=tz)
    rows = traded(bars, tz).withColumn("_bucket", time_bucket(F.col("ts"), bucket_minutes, tz))
    return rows.join(daily, ["sym", "_sd", "_bucket"], "left").drop("_sd", "_bucket")


def build_features(
    bars: DataFrame, generators: Sequence = DEFAULT_GENERATORS, *, tz: str = TIMEZONE, context: Mapping[str, DataFrame] | None = None,
    bucket_minutes: int = 30, span_days: int = 20,
) -> DataFrame:
    """sym, ts, session, is_traded and the features: a row's come from bars before it, but for deterministic ones.

    context: bars by symbol; each is aligned backward in time to the target's bars, and then lagged like all else.
    """
    rows = traded(bars, tz)
    if any(isinstance(g, BarrierVolatility) for g in generators) and "sigma" not in rows.columns:
        rows = with_sigma(bars, bucket_minutes=bucket_minutes, span_days=span_days, tz=tz).withColumn("_sd", session_date(F.col("ts"), tz))
    aligned = {}
    for n, (symbol, frame) in enumerate((context or {}).items()):
        other = frame.where("is_traded").drop("sym").withColumn("ctx_ts", F.col("ts"))
        rows = asof_backward(rows, other, f"_ctx{n}")
        aligned[symbol] = F.col(f"_ctx{n}")
    now: dict[str, Column] = {}
    later: dict[str, Column] = {}
    for g in generators:
        made = g.columns_with(aligned) if isinstance(g, ContextGenerator) else g.columns()
        (now if g.deterministic else later).update(made)
    made = rows.withColumns(now | later)
    lagged = {c: F.lag(c).over(day_window()) for c in later}
    order = [c for g in generators for c in (g.columns_with(aligned) if isinstance(g, ContextGenerator) else g.columns())]
    return made.withColumns(lagged).select("sym", "ts", "session", "is_traded", *order)
