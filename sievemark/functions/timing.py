"""Times as integers. Nothing here depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def event_time_ms(stamp: Column) -> Column:
    """Unix ms of a client's timestamp: below 1e11 it counts seconds, from 1e14 on microseconds; null for null, zero and negative ones."""
    stamp = stamp.cast("bigint")
    return (
        F.when(stamp <= 0, F.lit(None).cast("bigint"))
        .when(stamp < 100_000_000_000, stamp * 1000)
        .when(stamp >= 100_000_000_000_000, F.floor(stamp / F.lit(1000)).cast("bigint"))
        .otherwise(stamp)
    )


def ntz_micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a timestamp_ntz; null for null."""
    second = F.extract(F.lit("SECOND"), stamp) * F.lit(1_000_000)
    return (
        F.unix_date(stamp.cast("date")).cast("bigint") * F.lit(86_400_000_000)
        + F.hour(stamp).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(stamp).cast("bigint") * F.lit(60_000_000)
        + second.cast("bigint")
    )


def utc_day(ms: Column) -> Column:
    """The UTC date of Unix ms."""
    return F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int"))
