"""The exchange calendar and session tags."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import session_date
from tickloom.schemas import CALENDAR, SESSIONS, TIMEZONE

PRE_START, OPEN, CLOSE, EARLY_CLOSE, POST_END = time(4), time(9, 30), time(16), time(13), time(20)


def easter(year: int) -> date:
    """By the anonymous Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    month, day = divmod(h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114, 31)
    return date(year, month, day + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """n from 1, or -1 for the month's last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def observed(day: date) -> date | None:
    """A Sunday's holiday is kept on Monday, a Saturday's on Friday, but not in another year."""
    if day.weekday() == 6:
        return day + timedelta(1)
    if day.weekday() == 5:
        return day - timedelta(1) if (day - timedelta(1)).year == day.year else None
    return day


def holidays(year: int) -> set[date]:
    days = [
        observed(date(year, 1, 1)), nth_weekday(year, 1, 0, 3) if year >= 1998 else None, nth_weekday(year, 2, 0, 3), easter(year) - timedelta(2),
        nth_weekday(year, 5, 0, -1), observed(date(year, 6, 19)) if year >= 2022 else None, observed(date(year, 7, 4)),
        nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4), observed(date(year, 12, 25)),
    ]
    return {d for d in days if d}


def early_closes(year: int) -> set[date]:
    """The Friday after Thanksgiving, Christmas Eve and the third of July, where they are trading days."""
    days = {nth_weekday(year, 11, 3, 4) + timedelta(1), date(year, 12, 24), date(year, 7, 3)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def trading_days(first: date, last: date, closed: Iterable[date] = (), early: Iterable[date] = ()) -> list[tuple]:
    """(date, pre start, open, close, post end), the latter in UTC. closed, early: days beyond the rules."""
    zone, out, day = ZoneInfo(TIMEZONE), [], first
    while day <= last:
        if day.weekday() < 5 and day not in holidays(day.year) and day not in set(closed):
            close = EARLY_CLOSE if day in early_closes(day.year) or day in set(early) else CLOSE
            at = [datetime.combine(day, t, zone).astimezone(timezone.utc) for t in (PRE_START, OPEN, close, POST_END)]
            out.append((day, *at))
        day += timedelta(1)
    return out


def calendar(spark: SparkSession, first: date, last: date, **rules) -> DataFrame:
    """A row for each trading day; some 250 a year."""
    return spark.createDataFrame(trading_days(first, last, **rules), CALENDAR)


def calendar_for(rows: DataFrame, ts: str = "ts", **rules) -> DataFrame:
    """That of the dates which rows span."""
    low, high = rows.agg(F.min(session_date(F.col(ts))), F.max(session_date(F.col(ts)))).first()
    if low is None:
        raise ValueError("there are no rows to tag")
    return calendar(rows.sparkSession, low, high, **rules)


def session_of(ts: Column) -> Column:
    """By the joined calendar's columns; no trading day: OVERNIGHT."""
    pre, rth, post, overnight = SESSIONS
    return (
        F.when(F.col("pre_start").isNull() | (ts < F.col("pre_start")), overnight).when(ts < F.col("rth_open"), pre)
        .when(ts < F.col("rth_close"), rth).when(ts < F.col("post_end"), post).otherwise(overnight)
    )


def tag_sessions(rows: DataFrame, days: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds session. days is a calendar: a row a trading day, so it is broadcast."""
    tagged = rows.withColumn("_et", session_date(F.col(ts))).join(F.broadcast(days), F.col("_et") == F.col("et_date"), "left")
    return tagged.withColumn("session", session_of(F.col(ts))).drop("_et", *days.columns)
