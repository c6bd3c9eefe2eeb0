"""Timestamp columns: device conventions, formatting, truncation, gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric device timestamps above the first bound are epoch
# milliseconds, above the second epoch seconds.
MILLIS_ABOVE = 1_000_000_000_000
SECONDS_ABOVE = 1_000_000_000
# The first millisecond of the year 10000; no timestamp reaches it.
MILLIS_END = 253_402_300_800_000


def as_column(value) -> Column:
    """A Column from a Column, a datetime/date or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (dt.datetime, str)):
        return F.lit(str(value)).cast("timestamp")
    return F.lit(value)


def device_timestamp(raw: Column, now) -> Column:
    """Event time from 14 digits, epoch millis or epoch seconds; else `now`.

    Fourteen characters that are no calendar time, numbers beyond any calendar
    and numbers that are none give null.
    """
    text = raw.cast("string")
    number = text.try_cast("double")
    return (
        F.when(F.length(text) == 14, F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))
        .when(F.isnan(number) | (number >= MILLIS_END), F.lit(None).cast("timestamp"))
        .when(number > MILLIS_ABOVE, F.timestamp_millis(F.floor(number).cast("long")))
        .when(number > SECONDS_ABOVE, F.timestamp_millis(F.floor(number * 1000).cast("long")))
        .otherwise(as_column(now))
    )


def format_timestamp(ts: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss.SSS` in the session zone (UTC)."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def start_of_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def monday(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def start_of_month(ts: Column) -> Column:
    return F.trunc(ts, "month")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from `start` to `end`, counting crossed second boundaries."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def end_of_day(day) -> Column:
    """Last millisecond of a day, for inclusive ranges."""
    return as_column(str(day)) + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")
