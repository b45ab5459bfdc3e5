"""Broker histories: the source's contract, paced and paged requests, a replay of files as a data source, and ingestion."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import partial
from itertools import islice
from operator import itemgetter
from typing import Protocol
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tickloom.schemas import BAR, NOT_FILLED

UNITS, SECONDS, BID_ASK_WEIGHT = 60, 600, 2
TRIES, CHUNKS, STRIDE, BACKFILL, PAGE = 5, 500, timedelta(days=30), timedelta(days=30), timedelta(days=10)
COMPLETE_WITHIN = timedelta(days=4)


class BarSource(Protocol):
    """Bars whose start lies in [start, end), in order; maybe none."""

    def fetch(self, sym: str, start: datetime, end: datetime, series: str) -> list[tuple]: ...


def weight_of(series: str) -> int:
    return BID_ASK_WEIGHT if series == "BID_ASK" else 1


@dataclass
class Pacer:
    """At most `units` in any `seconds`; acquire() waits just long enough and returns how long.

    upto[k] is the weight of the first k requests, so that the request whose end makes room is found by search.
    """

    units: int = UNITS
    seconds: float = SECONDS
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    freed_at: list[float] = field(default_factory=list)
    upto: list[int] = field(default_factory=lambda: [0])

    def acquire(self, weight: int = 1) -> float:
        if not 0 < weight <= self.units:
            raise ValueError(f"a request must weigh 1 to {self.units} units, not {weight}")
        ended = bisect_left(self.upto, self.upto[-1] + weight - self.units)  # so many requests must have left the window
        begin = now = self.clock()
        while ended and now < self.freed_at[ended - 1]:
            self.sleep(self.freed_at[ended - 1] - now)
            now = self.clock()
        self.freed_at.append(now + self.seconds)
        self.upto.append(self.upto[-1] + weight)
        # as each weighs 1 at least, no more than `units` requests are within the window
        del self.freed_at[: -self.units], self.upto[: -self.units - 1]
        return now - begin


def budget_used(requests: DataFrame, seconds: int = SECONDS, block_windows: int = 64) -> DataFrame:
    """Adds used: the weight of a source's requests (source, ts, weight) in the last seconds, each request's own included.

    A source is dealt into blocks of so many windows; each block also gets what precedes it by less than a window.
    """
    at, size = F.unix_seconds("ts"), seconds * block_windows
    block = F.floor(at / size)
    reaches = F.floor((at + seconds - 1) / size)
    dealt = requests.withColumn("_blocks", F.array_distinct(F.array(block, reaches))).withColumn("_block", F.explode("_blocks"))
    recent = Window.partitionBy("source", "_block").orderBy(at).rangeBetween(1 - seconds, 0)
    return dealt.withColumn("used", F.sum("weight").over(recent)).where(F.col("_block") == block).drop("_blocks", "_block")


def with_retries(call: Callable[[], list], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, begin: int = 1) -> list:
    """call(), again after 2 ** begin seconds if it fails, then after twice that, and so on."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            sleep(2.0 ** (begin + n))
    return []


def pages(chunk: Callable[[datetime], list[tuple]], start: datetime, end: datetime) -> Iterator[list[tuple]]:
    """What precedes end, what precedes the first row of that, and so on, as long as this leads further back towards start."""
    while end > start and (page := chunk(end)):
        yield page
        first = min(map(itemgetter(1), page))
        end = first if first < end else start


def walk_back(chunk: Callable[[datetime], list[tuple]], start: datetime, end: datetime, most: int = CHUNKS) -> list[tuple]:
    """Rows in [start, end), their time at 1, in order, from a source that answers with what precedes a time; at most so many
    pages. Of rows of one time that on the later page counts."""
    by_time = {row[1]: row for page in islice(pages(chunk, start, end), most) for row in page if start <= row[1] < end}
    return sorted(by_time.values(), key=itemgetter(1))


def discover_depth(has_bars: Callable[[datetime, datetime], datetime | None], head: datetime, now: datetime, stride: timedelta = STRIDE) -> datetime | None:
    """The earliest time with bars: in the first stride after a coarse head that has some, or before it while strides have."""
    found = filter(None, (has_bars(a, b) for a, b in windows(head, now, stride)))
    first = next(found, None)
    before = lambda: first and has_bars(first - stride, first)
    while (earlier := before()) is not None and earlier < first:
        first = earlier
    return first


@dataclass
class PagedSource:
    """A BarSource over single requests, request(sym, end, series) giving the bars that precede a time, a page at most.

    Every try of a request waits for its share of the budget.
    """

    request: Callable[[str, datetime, str], list[tuple]]
    pacer: Pacer | None = None
    tries: int = TRIES
    sleep: Callable[[float], None] = time.sleep
    most: int = CHUNKS

    def _once(self, sym: str, series: str, end: datetime) -> list[tuple]:
        if self.pacer:
            self.pacer.acquire(weight_of(series))
        return self.request(sym, end, series)

    def page(self, sym: str, series: str, end: datetime) -> list[tuple]:
        return with_retries(partial(self._once, sym, series, end), self.tries, self.sleep, begin=0)

    def fetch(self, sym: str, start: datetime, end: datetime, series: str) -> list[tuple]:
        return walk_back(partial(self.page, sym, series), start, end, self.most)

    def earliest(self, sym: str, series: str, head: datetime, now: datetime) -> datetime | None:
        def has_bars(a: datetime, b: datetime) -> datetime | None:
            return next((r[1] for r in self.fetch(sym, a, b, series)), None)

        return discover_depth(has_bars, head, now)


@dataclass
class Recorded:
    """Bars in Parquet files, as requests: those of a page that ends before a time."""

    path: str
    page: timedelta = PAGE

    def __call__(self, sym: str, end: datetime, series: str) -> list[tuple]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        data = ds.dataset(self.path, format="parquet")
        kind = data.schema.field("ts").type
        at = lambda t: pa.scalar(t if kind.tz else t.replace(tzinfo=None), kind)
        mine = ds.field("sym") == sym
        if "series" in data.schema.names:
            mine &= ds.field("series") == series
        rows = data.to_table(columns=BAR.fieldNames(), filter=mine & (ds.field("ts") >= at(end - self.page)) & (ds.field("ts") < at(end)))
        if not len(rows):  # a gap longer than a page: the page that ends with the last bar before it
            last = pc.max(data.to_table(columns=["ts"], filter=mine & (ds.field("ts") < at(end))).column("ts"))
            if not last.is_valid:
                return []
            last = last.cast(pa.timestamp("us", "UTC" if kind.tz else None)).as_py().replace(tzinfo=timezone.utc)
            return self(sym, last + timedelta(microseconds=1), series)
        stamps = rows.column("ts").cast(pa.timestamp("us", "UTC" if kind.tz else None))  # Spark writes nanoseconds
        columns = rows.set_column(rows.schema.get_field_index("ts"), "ts", stamps).to_pydict().values()
        return [(sym, ts.replace(tzinfo=timezone.utc), *values) for _, ts, *values in sorted(zip(*columns), key=itemgetter(1))]


def utc(at: datetime, tz: str) -> datetime:
    """A vendor's naive time is of the zone asked for."""
    if not isinstance(at, datetime):
        raise TypeError(f"{at!r} is no time")
    return (at if at.tzinfo else at.replace(tzinfo=ZoneInfo(tz))).astimezone(timezone.utc)


def neutral(rows: DataFrame, sym: Column, tz: str, ts: str = "date") -> DataFrame:
    """Vendor rows as bars: naive local times to UTC, unfilled counts and averages marked."""
    mark = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(NOT_FILLED).cast(kind)).alias(c)
    return rows.select(sym.alias("sym"), F.to_utc_timestamp(F.col(ts), tz).alias("ts"), *[F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")], mark("bar_count", "bigint"), mark("wap", "double"))


@dataclass
class Span(InputPartition):
    sym: str
    start: datetime
    end: datetime

    def __init__(self, sym: str, start: datetime, end: datetime):
        super().__init__((sym, start, end))
        self.sym, self.start, self.end = sym, start, end


def windows(start: datetime, end: datetime, step: timedelta = BACKFILL) -> list[tuple[datetime, datetime]]:
    out = []
    while start < end:
        out.append((start, min(start + step, end)))
        start += step
    return out


class ReplaySource(DataSource):
    """Bars in recorded Parquet files, served like a broker's history: a partition for each symbol and window.

    A partition is read by paged requests. Options: path, symbols (by comma), start, end (ISO times), window_days, series;
    units and seconds for a budget of requests, of which each partition gets an equal share, one request at least.
    """

    @classmethod
    def name(cls) -> str:
        return "bar_replay"

    def schema(self) -> StructType:
        return BAR

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReplayReader(dict(self.options))


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = self.options
        start, end = (utc(datetime.fromisoformat(o[k]), "UTC") for k in ("start", "end"))
        step = timedelta(days=float(o.get("window_days", BACKFILL.days)))
        return [Span(s.strip(), a, b) for s in o["symbols"].split(",") for a, b in windows(start, end, step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        o = self.options
        # a source's budget holds for all of its requests, so each partition gets its share
        units = int(o["units"]) // max(1, len(self.partitions())) if "units" in o else 0
        pacer = Pacer(max(units, BID_ASK_WEIGHT), float(o.get("seconds", SECONDS))) if units else None
        yield from PagedSource(Recorded(o["path"]), pacer).fetch(partition.sym, partition.start, partition.end, o.get("series", "TRADES"))


@dataclass
class Ingestor:
    """Backfills and follows a source into a lake, in windows; each window is a snapshot."""

    spark: SparkSession
    lake: object
    source: BarSource
    request_timezone: str = "UTC"
    bar_size: str = "1 min"

    def frontier(self, sym: str, series: str) -> datetime | None:
        found = self.lake.manifests().where((F.col("sym") == sym) & (F.col("series") == series)).agg(F.max("end_ts")).first()[0]
        return found.replace(tzinfo=timezone.utc) if found else None

    def _fetch(self, sym: str, series: str, a: datetime, b: datetime) -> int:
        rows = self.source.fetch(sym, a, b, series)
        if rows:
            self.lake.write_snapshot(self.spark.createDataFrame(rows, BAR), series=series, request_timezone=self.request_timezone, bar_size=self.bar_size)
        return len(rows)

    def backfill(self, sym: str, series: str, earliest: datetime, end: datetime) -> int:
        """Goes on from what is there."""
        start = max(self.frontier(sym, series) or earliest, earliest)
        return sum(self._fetch(sym, series, a, b) for a, b in windows(start, end))

    def update(self, sym: str, series: str, end: datetime) -> int:
        """From the last bar on, which is fetched once more."""
        at = self.frontier(sym, series)
        if at is None:
            raise ValueError(f"{sym} {series} has no history; backfill it first")
        return sum(self._fetch(sym, series, a, b) for a, b in windows(at, end))

    def complete(self, sym: str, series: str, end: datetime, within: timedelta = COMPLETE_WITHIN) -> bool:
        at = self.frontier(sym, series)
        return at is not None and at >= end - within

    def follow(self, sym: str, series: str, clock: Callable[[], datetime], sleep: Callable[[float], None] = time.sleep, every: float = 60.0, polls: int | None = None) -> bool:
        """Updates until the history is complete, or so many times; whether it is."""
        n = 0
        while not self.complete(sym, series, clock()) and (polls is None or n < polls):
            if n:
                sleep(every)
            self.update(sym, series, clock())
            n += 1
        return self.complete(sym, series, clock())
