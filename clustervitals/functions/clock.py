"""The explicit clock.  Operators never read the wall clock; callers pass ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(when: datetime) -> Column:
    """A zone-free timestamp literal, so comparisons reach the parquet scan."""
    return F.lit(when.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def before(as_of: datetime, age: timedelta) -> Column:
    return instant(as_of - age)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microseconds, as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def whole_minutes(start: Column, end: Column) -> Column:
    """Elapsed minutes, rounded to even on a half as ``round(double)`` is in the database."""
    return F.rint(seconds_between(start, end) / F.lit(60.0)).cast("long")
