"""Business time between two timestamps as column expressions.

A working week is a number of work days counted from an anchor weekday, each 24 hours long. The
clock of a timestamp is the working time since the anchor, in whole microseconds, so that a
difference of two clocks is exact, signed and additive, and costs no row expansion.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

MONDAY = dt.date(1970, 1, 5)
SUNDAY = dt.date(1970, 1, 4)

# End states, the Gulf site, and the sites on the Beijing clock.
END_STATES = ["Resolved", "Closed"]
GULF_SITE = "DXB10"
BEIJING_SITES = ["PEK2", "PEK10", "PEK", "HND", "HND11", "JPN", "CHN"]
MANILA_SITE = "MNL"

BEIJING_AND_MANILA_SITES = [*BEIJING_SITES, MANILA_SITE]


def _ntz(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _time_of_day_us(ts: Column) -> Column:
    # Field by field: a cast to a zoned timestamp would shift times in a daylight-saving gap.
    seconds = F.extract(F.lit("SECOND"), ts)
    return (
        F.hour(ts).cast("bigint") * 3_600_000_000
        + F.minute(ts).cast("bigint") * 60_000_000
        + (seconds * 1_000_000).cast("bigint")
    )


def work_clock_us(ts: Column, work_days: Column, anchor: Column) -> Column:
    """Working microseconds from the anchor day to ``ts``."""
    day = F.datediff(ts, anchor)
    into_week = F.pmod(day, F.lit(7)).cast("bigint") * DAY_US + _time_of_day_us(ts)
    worked_week = work_days * F.lit(DAY_US)
    return F.floor(day / 7) * worked_week + F.least(into_week, worked_week)


def business_us(start, end, work_days=5, anchor=MONDAY) -> Column:
    """Signed working microseconds from start to end; null when either is null."""
    start, end = _ntz(start), _ntz(end)
    days = work_days if isinstance(work_days, Column) else F.lit(work_days)
    first = anchor if isinstance(anchor, Column) else F.lit(anchor)
    return work_clock_us(end, days, first) - work_clock_us(start, days, first)


def as_days(us: Column) -> Column:
    return us / F.lit(float(DAY_US))


def networkdays(start, end) -> Column:
    """Fractional work days, Monday to Friday."""
    return as_days(business_us(start, end))


def networkdays_six(start, end) -> Column:
    """Fractional work days, Monday to Saturday."""
    return as_days(business_us(start, end, 6))


def networkdays_seven(start, end) -> Column:
    """Fractional calendar days."""
    return as_days(business_us(start, end, 7))


def networkdays_gulf(start, end) -> Column:
    """Fractional work days, Sunday to Thursday."""
    return as_days(business_us(start, end, 5, SUNDAY))


def to_beijing(ts, source_zone: str = "UTC") -> Column:
    """Wall-clock time in Beijing of a zone-less timestamp read in ``source_zone``."""
    return F.convert_timezone(F.lit(source_zone), F.lit("Asia/Shanghai"), _ntz(ts))


def with_time_to_resolve(
    df: DataFrame,
    name: str,
    now: Column,
    beijing_sites: Sequence[str] = BEIJING_SITES,
    location: str = "location",
    days_week: str = "days_week",
    source_zone: str = "UTC",
) -> DataFrame:
    """Add the working microseconds a case took, or has taken up to ``now`` while it is open.

    The row's site and work week choose calendar and zone first; then one clock formula runs over
    the chosen values, whatever the calendar is.
    """
    site = F.col(location)
    gulf = F.coalesce(site == GULF_SITE, F.lit(False))
    beijing = F.coalesce(site.isin(list(beijing_sites)), F.lit(False))
    longer_week = F.when(F.col(days_week).isin(6, 7), F.col(days_week)).otherwise(5)
    end = F.when(F.col("status").isin(END_STATES), F.col("resolved_date")).otherwise(now)
    chosen = {
        "_work_days": F.when(gulf | beijing, 5).otherwise(longer_week),
        "_anchor": F.when(gulf, F.lit(SUNDAY)).otherwise(F.lit(MONDAY)),
        "_beijing": beijing,
        "_from": F.col("create_date"),
        "_to": end,
    }
    shifted = {
        c: F.when(F.col("_beijing"), to_beijing(F.col(c), source_zone)).otherwise(F.col(c))
        for c in ("_from", "_to")
    }
    taken = business_us("_from", "_to", F.col("_work_days"), F.col("_anchor"))
    return df.withColumns(chosen).withColumns(shifted).withColumn(name, taken).drop(*chosen)
