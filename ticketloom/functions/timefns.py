"""Local-time functions. Timestamps are TIMESTAMP_NTZ holding UTC, so no session zone leaks in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import REOPEN_HOURS, TIMEZONE


def parse_aware_timestamp(text: Column) -> Column:
    """UTC wall clock of an ISO text with Z or an offset; anything else, naive text too, is null."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2}(:\d{2})?)?)$")
    instant = F.try_to_timestamp(F.when(shaped, text))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def as_utc_ntz(column: Column, type_name: str) -> Column:
    """UTC wall clock of a TIMESTAMP or TIMESTAMP_NTZ column; the latter is taken as UTC already."""
    if type_name == "timestamp_ntz":
        return column
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))


def local_ts(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(TIMEZONE), ts)


def local_date(ts: Column) -> Column:
    return local_ts(ts).cast("date")


def monday_of(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def cohort_week(ts: Column) -> Column:
    return monday_of(local_date(ts))


def score_anchor(week: Column) -> Column:
    """Noon of the Monday, local time, as UTC."""
    noon = week.cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")
    return F.convert_timezone(F.lit(TIMEZONE), F.lit("UTC"), noon)


def is_weekend_start(ts: Column) -> Column:
    return F.weekday(local_date(ts)) >= 5


def week_mature(week: Column, as_of_local: Column, definition: Column) -> Column:
    """True once 168 hours have passed since the last microsecond of the week."""
    days = F.when(definition == "mon_sun", 7).otherwise(5)
    end = F.date_add(week, days).cast("timestamp_ntz")
    return as_of_local >= end - F.expr("INTERVAL '0.000001' SECOND") + F.expr(f"INTERVAL '{REOPEN_HOURS}' HOUR")


def within_reopen_window(ts: Column, start: Column) -> Column:
    return (ts > start) & (ts <= start + F.expr(f"INTERVAL '{REOPEN_HOURS}' HOUR"))


def utc_iso(ts: Column) -> Column:
    """ISO text with Z; microseconds only when there are any."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("Z"))


def week_needs_fetch(week: Column, fetched_at: Column, as_of: Column, horizon_days: int = 14, retry_hours: int = 0) -> Column:
    """A week is read again if never read, or until `horizon_days` after its last day."""
    recent = as_of.cast("date") <= F.date_add(week, 6 + horizon_days)
    due = recent if not retry_hours else recent & (as_of >= fetched_at + F.expr(f"INTERVAL '{retry_hours}' HOUR"))
    return fetched_at.isNull() | due
