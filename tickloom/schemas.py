"""Declared schemas of every layer. Timestamps are UTC and stamp a bar's start."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, LongType, StringType, StructType, TimestampType

_TYPES = {
    "string": StringType(), "timestamp": TimestampType(), "double": DoubleType(), "bigint": LongType(), "date": DateType(),
    "boolean": BooleanType(), "array<string>": ArrayType(StringType()),
}


def declared(columns: str) -> StructType:
    """Of "name type, ..."; unlike declared() it needs no session."""
    schema = StructType()
    for column in columns.split(", "):
        name, kind = column.split()
        schema.add(name, _TYPES[kind])
    return schema


_BAR = "sym string, ts timestamp, open double, high double, low double, close double, volume double, bar_count bigint, wap double"
BAR = declared(_BAR)
#: What a vendor's re-delivery may change.
VALUES = ("open", "high", "low", "close", "volume", "bar_count", "wap")
SNAPSHOT = declared(_BAR + ", series string, snapshot_id string, fetch_ts timestamp")
CALENDAR = declared("et_date date, pre_start timestamp, rth_open timestamp, rth_close timestamp, post_end timestamp")
VALIDATED = declared(
    "sym string, ts timestamp, session string, open double, high double, low double, close double, volume double, bar_count bigint, "
    "wap double, is_traded boolean, is_gap boolean, is_halt boolean, is_zero_volume boolean, is_price_anomaly boolean"
)
LABELS = declared(
    "sym string, decision_ts timestamp, entry_ts timestamp, exit_ts timestamp, label bigint, touched string, gross_return double, sigma double"
)
MANIFEST = declared(
    "snapshot_id string, sym string, series string, request_timezone string, bar_size string, fetch_ts timestamp, "
    "start_ts timestamp, end_ts timestamp, row_count bigint, files array<string>"
)
TRIALS = declared("registered_at timestamp, dataset_id string, trial_hash string, model_class string, auc double")
TOUCHES = declared("touched_at timestamp, dataset_id string, git_sha string, justification string")

SERIES = ("TRADES", "BID_ASK")
SESSIONS = ("PRE", "RTH", "POST", "OVERNIGHT")
#: A vendor's mark for a field that it did not fill.
NOT_FILLED = -1
TIMEZONE = "America/New_York"
