from pyspark.sql import functions as F

from casemetrics.functions import buckets, calendar, text
from tests.builders import at


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_correspondence_edges(spark):
    counts = [None, 0, 3, 4, 5, 10, 11, 25, 26, 27]
    low, mid, high = "1 to 3", "4 to 10", "11 to 25"
    expected = [None, low, low, low, mid, mid, high, high, high, ">25"]
    assert column(spark, counts, "int", buckets.correspondence_bucket) == expected


def test_age_edges(spark):
    ages = [None, -1, 4, 5, 10, 11, 31, 60, 61, 120, 121]
    expected = [None, "0 to 5", "0 to 5", "05 to 10", "05 to 10", "11 to 15", "31 to 60", "31 to 60"]
    expected += ["61 to 90", "91 to 120", "Above 120"]
    assert column(spark, ages, "int", buckets.age_bucket) == expected
    short = [None, 2, 3, 5, 6, 14, 15]
    expected = [None, "0 to 2", "3 to 5", "3 to 5", "6 to 8", "12 to 14", "Above 15"]
    assert column(spark, short, "int", buckets.short_age_bucket) == expected


def test_calendar_labels(spark):
    dates = ["2020-01-05 10:00:00", "2019-12-30 10:00:00", "2020-02-01 00:00:00", None]
    labels = lambda f: column(spark, [at(d) for d in dates], "timestamp_ntz", lambda _: f("v"))
    assert labels(calendar.week_label) == ["2020-2", "2019-1", "2020-5", None]
    assert labels(calendar.month_label) == ["2020-1", "2019-12", "2020-2", None]
    assert labels(calendar.weekday_number) == [0, 1, 6, None]
    assert labels(calendar.week_start)[0] == at("2019-12-30 00:00:00")
    assert labels(calendar.month_start)[1] == at("2019-12-01 00:00:00")
    assert labels(calendar.second_label)[0] == "2020-01-05 10:00:00"


def test_day_boundaries_count_midnights(spark):
    days = column(
        spark,
        [at("2020-01-01 23:59:00")],
        "timestamp_ntz",
        lambda v: calendar.day_boundaries(v, F.lit("2020-01-02 00:01:00").cast("timestamp_ntz")),
    )
    assert days == [1]


def test_number_marks(spark):
    marks = ["12", "999", "1000", "4f", "4R", "5d", "0", "", None, "9", "4ex", " 7", "1.5"]
    expected = [12, 999, None, None, None, None, None, None, None, 9, None, None, None]
    known = ["4f", "4r", "4a", "4c", "4na", "4ex"]
    assert column(spark, marks, "string", lambda v: text.number_mark(v, known)) == expected


def test_text_tests(spark):
    values = ["Pending HR", "nothing", None]
    assert column(spark, values, "string", lambda v: text.contains_any(v, ["pending", "x"])) == [
        True,
        False,
        None,
    ]
    kept = lambda v: text.not_in_or_null(v, ["nothing"])
    assert column(spark, values, "string", kept) == [True, False, True]
    assert column(spark, ["x", None, "y"], "string", text.is_blank) == [True, True, False]
    links = ["https://quick/123", "cool123", "Zebra", None]
    stripped = column(spark, links, "string", lambda v: text.strip_leading(v, "htps:/.amzoncquikl"))
    assert stripped == ["123", "123", "Zebra", None]
