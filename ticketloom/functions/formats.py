"""Vietnamese number formats used by the hand-off tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _swap(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def count_text(value: Column) -> Column:
    return F.coalesce(_swap(F.format_number(value.cast("bigint"), 0)), F.lit(DASH))


def rate_text(value: Column) -> Column:
    percent = F.when(value.isin(0.0, 1.0), F.format_number(value * 100, 0)).otherwise(F.format_number(F.round(value * 100, 1), 1))
    return F.coalesce(F.concat(_swap(percent), F.lit("%")), F.lit(DASH))


def average_text(value: Column) -> Column:
    return F.coalesce(_swap(F.format_number(F.round(value, 2), 2)), F.lit(DASH))


def points_text(value: Column) -> Column:
    return _swap(F.format_number(F.round(value, 1), 1))


def week_range_text(week: Column, days: Column) -> Column:
    return F.concat(F.date_format(week, "dd/MM"), F.lit("–"), F.date_format(F.date_add(week, days), "dd/MM"))


def share_with_guard(count: Column, total: Column, minimum: int) -> Column:
    """Share only when the denominator is large enough."""
    return F.when(total >= minimum, count / total)
