"""Date and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(s: Column, pattern: str | None = None) -> Column:
    """Timestamp of a string, NULL where it does not parse."""
    return F.try_to_timestamp(s, F.lit(pattern)) if pattern else F.try_to_timestamp(s)


def replace_year(d: Column, year: int) -> Column:
    """Same month and day in another year; NULL for 29 February of a common year."""
    return F.concat(F.lit(f"{year:04d}"), F.date_format(d, "-MM-dd")).try_cast("date")


def ordinal(d: Column) -> Column:
    """Days since 0001-01-01, which is day 1."""
    return F.datediff(d, F.lit("0001-01-01").cast("date")) + 1
