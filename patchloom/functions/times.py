"""Timestamps, calendar buckets and gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp."""
    return F.to_timestamp(text)


def year_month(ts: Column) -> Column:
    """``YYYY-MM``."""
    return F.date_format(ts, "yyyy-MM")


def gap_micros(start: Column, end: Column) -> Column:
    """Elapsed microseconds, also for timestamps without time zone."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def gap_days(start: Column, end: Column) -> Column:
    """Whole elapsed days, rounded down (not calendar days)."""
    return F.floor(gap_micros(start, end) / F.lit(float(DAY_MICROS)))


def gap_hours(start: Column, end: Column) -> Column:
    """Elapsed hours with fraction."""
    return gap_micros(start, end) / F.lit(float(HOUR_MICROS))


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))
