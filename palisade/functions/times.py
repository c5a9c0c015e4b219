"""Timestamps: normalisation, windows and calendars. Everything is UTC and takes
the reference moment as a parameter; nothing reads the clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import col

# Fixed value: larger integers are milliseconds, others seconds.
MILLIS_ABOVE = 10_000_000_000

COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})?(\.\d+)?([Zz]|[+-]\d{2}(?::?\d{2})?)?$"


def normalize_timestamp(raw) -> Column:
    """Text of a JSON timestamp (integer ms, integer s or ISO-8601) to a
    timestamp. The ISO text may be compact (20240101T120000Z) and needs a date: a time of
    day alone is unreadable. Zero and empty count as missing; missing and unreadable
    give null."""
    text = F.nullif(F.trim(col(raw)), F.lit(""))
    part = lambda i: F.regexp_extract(text, COMPACT, i)
    seconds = F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))
    spelt = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), seconds, part(7), F.upper(part(8)))
    iso = F.when(F.regexp_like(text, F.lit(COMPACT)), spelt).when(F.regexp_like(text, F.lit(r"^\d{4}-\d{1,2}")), text)
    # tested before it is cast: a failing cast costs an exception per row
    number = F.when(F.regexp_like(text, F.lit(r"^-?\d{1,18}$")), text.cast("bigint"))
    return (
        F.when(number == 0, F.lit(None).cast("timestamp"))
        .when(number > MILLIS_ABOVE, F.timestamp_millis(number))
        .when(number.isNotNull(), F.timestamp_seconds(number))
        .otherwise(iso.try_cast("timestamp"))
    )


def epoch_ms(ts) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def business_hours(ts, start_hour: int = 9, end_hour: int = 17) -> Column:
    hour = F.hour(col(ts))
    return (hour >= start_hour) & (hour < end_hour)


def elapsed_days(start, end) -> Column:
    """Whole 24-hour days between two moments, rounded down."""
    micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def time_window(kind: str, as_of: datetime, start: datetime | None = None,
                end: datetime | None = None, months: int = 3) -> tuple[datetime, datetime]:
    """Bounds, both inclusive, of a named reporting window."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if kind == "today":
        return midnight, as_of
    if kind == "yesterday":
        return midnight - timedelta(days=1), midnight - timedelta(microseconds=1)
    if kind == "week":
        return as_of - timedelta(days=7), as_of
    if kind == "months":
        return as_of - timedelta(days=30 * months), as_of
    if kind == "custom":
        if start is None or end is None or end < start:
            raise ValueError("a custom window needs start <= end")
        return start, end
    raise ValueError(f"unknown window {kind!r}")


def calendar(ranges: DataFrame, start: str, end: str, unit: str, name: str) -> DataFrame:
    """ranges (columns start and end) with a row for every hour or day from the one holding
    start to the one holding end, both included. Years are made first and dealt out, then
    their days, then the hours of a day: no array holds more than one step's, and no task
    makes the whole of a long calendar."""
    y, d = "__year", "__day"
    first, last = F.date_trunc(unit, F.col(start)), F.date_trunc(unit, F.col(end))
    known = ranges.where(F.col(start) <= F.col(end))
    years = known.withColumn(y, F.explode(F.sequence(F.year(start), F.year(end)))).repartition(y)
    low = F.greatest(F.make_date(F.col(y), F.lit(1), F.lit(1)), F.to_date(start))
    high = F.least(F.make_date(F.col(y), F.lit(12), F.lit(31)), F.to_date(end))
    days = years.withColumn(d, F.explode(F.sequence(low, high).cast("array<timestamp>")))
    if unit == "day":
        return days.withColumnRenamed(d, name).drop(y)
    hours = days.withColumn(name, F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.col(d) + F.make_dt_interval(hours=h))))
    return hours.where(F.col(name).between(first, last)).drop(y, d)
