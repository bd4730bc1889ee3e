"""Dates and times. Timestamps are UTC with microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def parse_instant(value: Column, data_type: str) -> Column:
    """Timestamp of a column; text that is not an ISO date or time becomes null."""
    if data_type == "string":
        return F.try_to_timestamp(value)
    return value.cast("timestamp")


def day_text(value: Column) -> Column:
    return F.to_date(value).cast("string")


def month_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def floored_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, rounded down (minus half a day is -1)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(MICROS_PER_DAY))


def day_number(value: Column) -> Column:
    """Days since the epoch: a deterministic bucket that grows with time."""
    return F.floor(F.unix_micros(value) / F.lit(MICROS_PER_DAY))
