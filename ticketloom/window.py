"""Reporting window: which local weeks are reported and which UTC range is read."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TIMEZONE

LOOKBACK_DAYS = 14
_ZONE = ZoneInfo(TIMEZONE)


def ntz(value: datetime) -> Column:
    """Literal TIMESTAMP_NTZ from a wall-clock datetime."""
    return F.expr(f"TIMESTAMP_NTZ '{value.replace(tzinfo=None).isoformat(sep=' ')}'")


@dataclass(frozen=True)
class CohortWindow:
    as_of: datetime
    start: date
    end: date
    wtd_start: date | None

    @classmethod
    def build(cls, as_of: datetime, weeks: int, include_running_week: bool = True) -> "CohortWindow":
        if as_of.tzinfo is None:
            raise ValueError("as_of must carry a time zone")
        if weeks < 1:
            raise ValueError("weeks must be at least 1")
        local_day = as_of.astimezone(_ZONE).date()
        monday = local_day - timedelta(days=local_day.weekday())
        return cls(as_of, monday - timedelta(weeks=weeks), monday, monday if include_running_week else None)

    @property
    def as_of_local(self) -> datetime:
        return self.as_of.astimezone(_ZONE)

    @property
    def as_of_utc(self) -> datetime:
        return self.as_of.astimezone(timezone.utc)

    @property
    def query_from_utc(self) -> datetime:
        start = datetime.combine(self.start, time.min, tzinfo=_ZONE) - timedelta(days=LOOKBACK_DAYS)
        return start.astimezone(timezone.utc)

    @property
    def query_to_utc(self) -> datetime:
        if self.wtd_start is not None:
            return self.as_of_utc
        return datetime.combine(self.end, time.min, tzinfo=_ZONE).astimezone(timezone.utc)

    @property
    def weeks(self) -> list[tuple[date, str]]:
        """(Monday, status) of every reported week, empty ones included."""
        rows = [(self.start + timedelta(weeks=i), "complete") for i in range((self.end - self.start).days // 7)]
        if self.wtd_start is not None:
            rows.append((self.wtd_start, "wtd"))
        return rows

    def effective_status(self, week: date, status: str, definition: str) -> str:
        last_day = week + timedelta(days=4 if definition == "mon_fri" else 6)
        return "complete" if status == "wtd" and self.as_of_local.date() > last_day else status

    def is_mature(self, week: date, definition: str) -> bool:
        """True once 168 hours have passed since the last microsecond of the week."""
        days = 7 if definition == "mon_sun" else 5
        end = datetime.combine(week + timedelta(days=days), time.min, tzinfo=_ZONE)
        return self.as_of >= end - timedelta(microseconds=1) + timedelta(hours=168)

    def cohort_status(self, local: Column) -> Column:
        """complete / wtd / out_of_scope of a local timestamp."""
        status = F.when(
            (local >= ntz(datetime.combine(self.start, time.min))) & (local < ntz(datetime.combine(self.end, time.min))),
            F.lit("complete"),
        )
        if self.wtd_start is not None:
            status = status.when(
                (local >= ntz(datetime.combine(self.wtd_start, time.min))) & (local <= ntz(self.as_of_local)), F.lit("wtd")
            )
        return status.otherwise(F.lit("out_of_scope"))
