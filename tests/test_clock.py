import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casemetrics.functions import clock as C
from tests.builders import at


def days(spark, function, pairs):
    df = spark.createDataFrame(
        [(i, at(a), at(b)) for i, (a, b) in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz"
    )
    return [r[0] for r in df.orderBy("i").select(function("a", "b")).collect()]


def test_named_spans(spark):
    friday, monday = "2020-01-03 12:00:00", "2020-01-06 12:00:00"
    pairs = [
        (friday, monday),
        ("2020-01-04 03:00:00", "2020-01-05 20:00:00"),
        (monday, friday),
        ("1969-12-31 00:00:00", "1970-01-07 00:00:00"),
        (friday, None),
    ]
    assert days(spark, C.networkdays, pairs) == [1.0, 0.0, -1.0, 5.0, None]
    assert days(spark, C.networkdays_six, pairs)[:2] == [2.0, 0.875]
    assert days(spark, C.networkdays_seven, pairs)[0] == 3.0
    thursday, sunday = "2020-01-02 12:00:00", "2020-01-05 12:00:00"
    assert days(spark, C.networkdays_gulf, [(thursday, sunday)]) == [1.0]


def counted(a, b, open_days):
    """Working minutes by counting them one by one."""
    if b < a:
        return -counted(b, a, open_days)
    total, t = 0, a
    while t < b:
        total += t.weekday() in open_days
        t += dt.timedelta(minutes=1)
    return total


WEEKS = [
    (C.networkdays, {0, 1, 2, 3, 4}),
    (C.networkdays_six, {0, 1, 2, 3, 4, 5}),
    (C.networkdays_seven, set(range(7))),
    (C.networkdays_gulf, {6, 0, 1, 2, 3}),
]


@pytest.mark.parametrize("function,open_days", WEEKS)
def test_equals_counting(spark, function, open_days):
    rng = random.Random(7)
    base = dt.datetime(1969, 12, 20)
    pick = lambda: base + dt.timedelta(minutes=rng.randrange(40_000))
    pairs = [(pick(), pick()) for _ in range(40)]
    found = days(spark, function, [(str(a), str(b)) for a, b in pairs])
    for (a, b), value in zip(pairs, found):
        assert value == pytest.approx(counted(a, b, open_days) / 1440, abs=1e-9)


def test_properties(spark):
    rng = random.Random(3)
    base = dt.datetime(2018, 1, 1)
    rows = [
        tuple(base + dt.timedelta(microseconds=rng.randrange(10**14)) for _ in range(3))
        for _ in range(200)
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")
    us = lambda x, y, d=5: C.business_us(x, y, d)
    checks = df.select(
        (us("a", "b") == -us("b", "a")).alias("signed"),
        (us("a", "b") + us("b", "c") == us("a", "c")).alias("additive"),
        (
            (F.abs(us("a", "b")) <= F.abs(us("a", "b", 6)))
            & (F.abs(us("a", "b", 6)) <= F.abs(us("a", "b", 7)))
        ).alias("ordered"),
    )
    assert checks.distinct().collect() == [(True, True, True)]


def test_zone_of_session_plays_no_part(spark):
    df = spark.createDataFrame(
        [(at("2020-03-29 02:30:00"), at("2020-03-30 02:30:00"))], "a timestamp_ntz, b timestamp_ntz"
    )
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        row = df.select(
            C.networkdays_seven("a", "b"), C.networkdays("a", "b"), C.to_beijing("a")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == (1.0, 2.5 / 24, at("2020-03-29 10:30:00"))


def test_dispatch(spark):
    friday, monday, now = "2020-01-03 18:00:00", "2020-01-06 12:00:00", "2020-01-07 12:00:00"
    rows = [
        ("gulf", "DXB10", 7, "Resolved"),
        ("beijing", "PEK", 7, "Resolved"),
        ("manila", "MNL", 7, "Closed"),
        ("six", "X", 6, "Resolved"),
        ("seven", "X", 7, "Resolved"),
        ("none", None, None, "Resolved"),
        ("open", "X", 5, "Assigned"),
        ("no status", "X", 5, None),
    ]
    df = spark.createDataFrame(
        [(n, l, w, s, at(friday), at(monday)) for n, l, w, s in rows],
        "name string, location string, days_week int, status string,"
        " create_date timestamp_ntz, resolved_date timestamp_ntz",
    )
    end = F.lit(now).cast("timestamp_ntz")
    df = C.with_time_to_resolve(df, "sla", end)
    df = C.with_time_to_resolve(df, "shown", end, C.BEIJING_AND_MANILA_SITES)
    hours = {r.name: (r.sla / 3.6e9, r.shown / 3.6e9) for r in df.collect()}
    assert hours == {
        "gulf": (36.0, 36.0),
        "beijing": (20.0, 20.0),
        "manila": (66.0, 20.0),
        "six": (42.0, 42.0),
        "seven": (66.0, 66.0),
        "none": (18.0, 18.0),
        "open": (42.0, 42.0),
        "no status": (42.0, 42.0),
    }
    assert "_from" not in df.columns
