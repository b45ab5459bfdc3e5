"""Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schemas import TIMEZONE


def local(ts: Column, tz: str = TIMEZONE) -> Column:
    return F.from_utc_timestamp(ts, tz)


def session_date(ts: Column, tz: str = TIMEZONE) -> Column:
    """The exchange's date, at which features start anew. Not the date that files are partitioned by, which is UTC's."""
    return F.to_date(local(ts, tz))


def minute_of_day(ts: Column, tz: str = TIMEZONE) -> Column:
    at = local(ts, tz)
    return (F.hour(at) * 60 + F.minute(at)).cast("bigint")


def time_bucket(ts: Column, minutes: int, tz: str = TIMEZONE) -> Column:
    return F.floor(minute_of_day(ts, tz) / minutes).cast("bigint")


def log_or_null(x: Column) -> Column:
    """Of prices; null unless positive."""
    return F.when(x > 0, F.ln(x))


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0, as division by zero is an error in ANSI mode."""
    return F.try_divide(a, b)


def zero_if_undefined(x: Column) -> Column:
    """Null and NaN become 0, infinities the largest finite numbers."""
    largest = F.lit(1.7976931348623157e308)
    x = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(x, largest), -largest)


def ewma(values: Column, span: float) -> Column:
    """Last value of an exponentially weighted mean over an array in order, weights (1 - 2 / (span + 1)) ** age, normalised."""
    keep = 1.0 - 2.0 / (span + 1.0)
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    return F.aggregate(
        values, zero,
        lambda s, x: F.struct((s["num"] * keep + x).alias("num"), (s["den"] * keep + 1.0).alias("den")),
        lambda s: F.when(s["den"] > 0, s["num"] / s["den"]),
    )


def nearest_quantile(sorted_values: Column, q: float) -> Column:
    """Of a sorted array, the element at round((n - 1) * q), halves up."""
    at = F.floor((F.size(sorted_values) - 1) * F.lit(q) + F.lit(0.5)).cast("int") + 1
    return F.when(F.size(sorted_values) > 0, F.element_at(sorted_values, F.greatest(at, F.lit(1))))


def touched_name(code: Column) -> Column:
    """1 tp, -1 sl, 2 both, 0 vertical; anything else is an error."""
    return (
        F.when(code == 1, "tp").when(code == -1, "sl").when(code == 2, "both").when(code == 0, "vertical")
        .otherwise(F.raise_error(F.concat(F.lit("unknown touch code "), F.coalesce(code.cast("string"), F.lit("null")))))
    )
