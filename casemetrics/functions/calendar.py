"""Calendar labels and day counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemetrics.functions.clock import END_STATES


def second_label(ts: str) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, cut from the text form so that no time zone takes part."""
    return F.substring(F.col(ts).cast("string"), 1, 19)


def month_label(ts: str) -> Column:
    """``year-month`` without zero padding."""
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.month(ts).cast("string"))


def weekday_number(ts: str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(ts) - 1


def week_label(ts: str) -> Column:
    """``year-week``: ISO week numbers on the calendar year, a Sunday counting to the next week."""
    week = F.weekofyear(ts) + F.when(weekday_number(ts) == 0, 1).otherwise(0)
    return F.concat(F.year(ts).cast("string"), F.lit("-"), week.cast("string"))


def day_boundaries(start: Column, end: Column) -> Column:
    """Midnights between two timestamps, not whole 24-hour spans."""
    return F.datediff(end, start)


def closed_month(ts: str, status: str = "status") -> Column:
    """First instant of the month for a case in an end state, else null."""
    return F.when(F.col(status).isin(END_STATES), month_start(ts))


def month_start(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "month").cast("timestamp_ntz")


def week_start(ts: str) -> Column:
    """Monday midnight of the week."""
    return F.trunc(F.to_date(ts), "week").cast("timestamp_ntz")
