"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def iso_day(text: Column) -> Column:
    """Day prefix of an ISO timestamp kept as text."""
    return F.substring(text, 1, 10)


def year_of(ts: Column) -> Column:
    return F.year(ts).cast("int")


def month_of(ts: Column) -> Column:
    return F.month(ts).cast("int")


def day_no(ts: Column) -> Column:
    return F.dayofmonth(ts).cast("int")


def bimester(month: Column) -> Column:
    """Two-month period of a month number: 1 for January and February, ... 6."""
    return F.floor((month + 1) / 2).cast("int")


def try_date(text: Column) -> Column:
    """Parsed date, or null where the text is no date."""
    return F.try_to_timestamp(text).cast("date")


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def utc_stamp(now: Column) -> Column:
    """ISO stamp with a trailing Z; the instant is a parameter, so plans repeat."""
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
