"""Scalar columns that views of the ledger are made of."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, stop: Column) -> Column:
    return F.timestamp_diff("SECOND", start, stop)


def remaining(processed: Column, failed: Column, total: Column) -> Column:
    return F.greatest(F.lit(0), total - processed - failed)


def percent_succeeded(processed: Column, failed: Column, total: Column) -> Column:
    """Whole percent, 0 to 100, of (processed - failed); processed leaves failures out already, and is meant so."""
    return F.least(F.greatest(F.floor((processed - failed) * 100 / total).cast("int"), F.lit(0)), F.lit(100))


def duration_text(seconds: Column) -> Column:
    """Seconds below a minute, then minutes and seconds, then hours and minutes."""
    part = lambda n, d: F.floor(n / d).cast("long").cast("string")
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(part(seconds, 60), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(part(seconds, 3600), F.lit("h "), part(seconds % 3600, 60), F.lit("m")))
    )


def age_text(seconds: Column) -> Column:
    """How long ago, in the largest whole unit; the future counts as now."""
    s = F.greatest(seconds, F.lit(0))
    unit = lambda d, u: F.concat(F.floor(s / d).cast("long").cast("string"), F.lit(f"{u} ago"))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def largest_unit(minutes: Column) -> Column:
    """The largest unit that gives the minutes exactly."""
    return F.when(minutes % 1440 == 0, "days").when(minutes % 60 == 0, "hours").otherwise("minutes")


def backoff_seconds(attempt: Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    """Delay before the attempt after ``attempt``: base times factor to (attempt - 1), at most cap."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(cap))


def time_ordered_id() -> str:
    """32 hex digits that sort by time: milliseconds, version 7, random bits."""
    n = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10), "big")
    n = n & ~(0xF << 76) | (7 << 76)
    return f"{n & ~(3 << 62) | (2 << 62):032x}"
