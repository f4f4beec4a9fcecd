"""Queries G1 to I9: scalar functions, the business clock, buckets and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemetrics.config import fixed_values as V
from casemetrics.functions import clock as C
from casemetrics.functions.buckets import age_bucket, correspondence_bucket, short_age_bucket
from casemetrics.functions.calendar import (
    closed_month,
    day_boundaries,
    month_label,
    month_start,
    second_label,
    week_label,
    week_start,
    weekday_number,
)
from casemetrics.functions.text import number_mark, strip_leading
from casemetrics.operators.rollup import audit_rollup, quicklink_texts
from casemetrics.operators.rules import first_match
from casemetrics.operators.sizing import lookup_join
from casemetrics.plans.case_frame import case_frame
from casemetrics.plans.ttr_percentiles import load_time, reported_groups
from casemetrics.plans.views import case_weight, contact_flags, mark_flags
from workload import oracle as O
from workload.registry import given_query, query
from workload.roles import OPTIONS, PEOPLE, given


@query(
    "g1_lower_upper",
    """SELECT DISTINCT lower(employee_login) AS login,
    upper(reports_to_level_2_employee_login) AS manager FROM headcount""",
)
def lower_upper(tables):
    return tables.headcount.select(
        F.lower("employee_login").alias("login"),
        F.upper("reports_to_level_2_employee_login").alias("manager"),
    ).distinct()


@query(
    "g2_concat",
    "SELECT case_id, root_cause || resolution AS both_texts FROM tickets",
)
def concat(tables):
    return tables.tickets.select("case_id", F.concat("root_cause", "resolution").alias("both_texts"))


@query(
    "g3_left",
    """SELECT case_id, left(item, 3) AS item_start, CAST(resolved_date AS DATE) AS resolved_day
    FROM tickets""",
)
def left(tables):
    return tables.tickets.select(
        "case_id",
        F.substring("item", 1, 3).alias("item_start"),
        F.to_date("resolved_date").alias("resolved_day"),
    )


@given_query("g4_length", "SELECT doc_id, length(text) AS characters FROM documents")
def length(spark, folder):
    documents = given(spark, folder, "documents")
    return documents.select("doc_id", F.length("text").alias("characters"))


@query(
    "g5_strip_leading",
    """SELECT case_id, ltrim(quicklink_text, 'htps:/.amzoncquikl') AS quicklink_id FROM trail
    WHERE quicklink_text IS NOT NULL""",
    {"trail": O.TRAIL},
)
def strip(tables):
    link = strip_leading(F.col("quicklink_text"), V.QUICKLINK_PREFIX_CHARACTERS)
    return quicklink_texts(tables.audit, OPTIONS).select("case_id", link.alias("quicklink_id"))


@query(
    "g6_text_to_number",
    f"""SELECT case_id, to_string, CASE WHEN to_string >= '1' AND to_string <= '9999'
        AND lower(to_string) NOT IN {O.listing(V.NOT_COUNTS)} AND length(to_string) < 4
        THEN TRY_CAST(to_string AS INTEGER) END AS number FROM audit""",
)
def text_to_number(tables):
    number = number_mark(F.col("to_string"), V.NOT_COUNTS)
    return tables.audit.select("case_id", "to_string", number.alias("number"))


@query("g7_cast_to_text", "SELECT case_id, CAST(year(create_date) AS VARCHAR) AS label FROM tickets")
def cast_to_text(tables):
    return tables.tickets.select("case_id", F.year("create_date").cast("string").alias("label"))


@query("g8_null_default", "SELECT case_id, coalesce(root_cause, 'x') AS root_cause FROM tickets")
def null_default(tables):
    return tables.tickets.select("case_id", F.coalesce("root_cause", F.lit("x")).alias("root_cause"))


NOON = "TIMESTAMP '2024-01-13 15:30:00'"


def noon():
    return F.lit("2024-01-13 15:30:00").cast("timestamp_ntz")


@given_query("g9_abs", f"SELECT event_id, abs({O.span(NOON, 'ts', 7)}) AS apart_us FROM events")
def absolute(spark, folder):
    events = given(spark, folder, "events")
    return events.select("event_id", F.abs(C.business_us(noon(), "ts", 7)).alias("apart_us"))


@given_query("g10_sign", f"SELECT event_id, sign({O.span(NOON, 'ts', 7)}) AS side FROM events")
def sign(spark, folder):
    side = F.signum(C.business_us(noon(), "ts", 7)).cast("int")
    return given(spark, folder, "events").select("event_id", side.alias("side"))


@query(
    "g11_text_to_date",
    """SELECT case_id, CAST(strptime(strftime(create_date, '%Y/%m/%d'), '%Y/%m/%d') AS DATE)
    AS parsed_day FROM tickets""",
)
def text_to_date(tables):
    text = F.date_format("create_date", "yyyy/MM/dd")
    return tables.tickets.select("case_id", F.to_date(text, "yyyy/MM/dd").alias("parsed_day"))


@given_query("g12_time_to_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS label FROM events")
def time_to_text(spark, folder):
    return given(spark, folder, "events").select("event_id", second_label("ts").alias("label"))


@given_query("g13_time_to_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def time_to_day(spark, folder):
    return given(spark, folder, "events").select("event_id", F.to_date("ts").alias("day"))


@given_query(
    "g14_period_start",
    """SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS month_start,
    date_trunc('week', ts)::TIMESTAMP AS week_start FROM events""",
)
def period_start(spark, folder):
    return given(spark, folder, "events").select(
        "event_id", month_start("ts").alias("month_start"), week_start("ts").alias("week_start")
    )


@query(
    "g15_date_parts",
    """SELECT case_id, year(create_date) AS year, month(create_date) AS month,
    weekofyear(create_date) AS week, dayofweek(create_date) AS weekday FROM tickets""",
)
def date_parts(tables):
    return tables.tickets.select(
        "case_id",
        F.year("create_date").alias("year"),
        F.month("create_date").alias("month"),
        F.weekofyear("create_date").alias("week"),
        weekday_number("create_date").alias("weekday"),
    )


@query(
    "g16_day_boundaries",
    "SELECT case_id, date_diff('day', create_date, resolved_date) AS days FROM tickets",
)
def boundaries(tables):
    days = day_boundaries(F.col("create_date"), F.col("resolved_date"))
    return tables.tickets.select("case_id", days.alias("days"))


@query("g17_run_time", f"SELECT case_id, {O.NOW} AS run_time FROM tickets")
def run_time(tables):
    return tables.tickets.select("case_id", OPTIONS.run_time().alias("run_time"))


@query(
    "g18_date_arithmetic",
    f"""SELECT case_id, resolved_date FROM tickets WHERE CAST(resolved_date AS DATE)
    BETWEEN CAST({O.NOW} AS DATE) - 30 AND CAST({O.NOW} AS DATE) - 1""",
)
def date_arithmetic(tables):
    today = F.to_date(OPTIONS.run_time())
    window = F.to_date("resolved_date").between(F.date_sub(today, 30), F.date_sub(today, 1))
    return tables.tickets.filter(window).select("case_id", "resolved_date")


@query(
    "g19_case",
    """SELECT case_id, CASE impact WHEN 1 THEN 'high' WHEN 2 THEN 'high' END AS simple,
    CASE WHEN impact < 3 THEN 'high' WHEN closure_code = 'Duplicate' THEN 'twice' ELSE 'low' END
    AS searched FROM tickets""",
)
def cases(tables):
    return tables.tickets.select(
        "case_id",
        first_match([(F.col("impact").isin(1, 2), "high")]).alias("simple"),
        first_match(
            [(F.col("impact") < 3, "high"), (F.col("closure_code") == "Duplicate", "twice")], "low"
        ).alias("searched"),
    )


def _clock_query(name: str, function, days: int, anchor: str = "1970-01-05") -> None:
    sql = f"SELECT event_id, {O.in_days(O.span(NOON, 'ts', days, anchor))} AS days FROM events"

    @given_query(name, sql)
    def run(spark, folder):
        return given(spark, folder, "events").select("event_id", function(noon(), "ts").alias("days"))


_clock_query("h1_networkdays", C.networkdays, 5)
_clock_query("h2_networkdays_six", C.networkdays_six, 6)
_clock_query("h3_networkdays_seven", C.networkdays_seven, 7)
_clock_query("h4_networkdays_gulf", C.networkdays_gulf, 5, "1970-01-04")


@given_query("h5_beijing_time", "SELECT event_id, ts + INTERVAL '8' HOUR AS beijing FROM events")
def beijing_time(spark, folder):
    return given(spark, folder, "events").select("event_id", C.to_beijing("ts").alias("beijing"))


ENDED = """CASE WHEN status IN ('Resolved', 'Closed') THEN resolved_date
    ELSE (SELECT max(dw_last_updated) FROM tickets) END"""


@query(
    "h6_time_to_resolve",
    f"""SELECT case_id, {O.in_days(O.taken(O.BEIJING, "create_date", "ended"))} AS sla_ttr,
    {O.in_days(O.taken(O.BEIJING_OR_MANILA, "create_date", "ended"))} AS shown_ttr
    FROM (SELECT *, {ENDED} AS ended FROM tickets) AS t
    LEFT JOIN reported ON assigned_to_group = resolver_group""",
    {"reported": O.REPORTED},
)
def time_to_resolve(tables):
    groups = reported_groups(tables.groups).select(
        F.col("resolver_group").alias("assigned_to_group"), "location", "days_week"
    )
    cases = lookup_join(tables.tickets, groups, ["assigned_to_group"], tables.fits["groups"])
    cases = cases.withColumn("loaded", load_time(tables))
    end = F.col("loaded")
    cases = C.with_time_to_resolve(cases, "sla_us", end, C.BEIJING_SITES)
    cases = C.with_time_to_resolve(cases, "shown_us", end, C.BEIJING_AND_MANILA_SITES)
    return cases.select(
        "case_id",
        C.as_days(F.col("sla_us")).alias("sla_ttr"),
        C.as_days(F.col("shown_us")).alias("shown_ttr"),
    )


POSITIVE = {
    "reopened": "reopened",
    "routed": "routed",
    "pending": "pending",
    "escalated": "escalated",
    "4a": "four_a",
    "4r": "four_r",
    "4c": "four_c",
    "4f": "four_f",
    "created_from_quicklink": "created_from_quicklink",
}
POSITIVE_SQL = ", ".join(
    f"""CASE WHEN trail.{count} > 0 THEN 'Y' ELSE 'N' END AS "{name}\"""" for name, count in POSITIVE.items()
)


@query(
    "i1_contact_flags",
    f"""SELECT t.case_id, CASE WHEN reopened + routed + pending > 0 THEN 'N' ELSE 'Y' END AS fcr,
    {POSITIVE_SQL}, CASE WHEN root_cause = 'No Defect' THEN 'N' ELSE 'Y' END AS defect
    FROM tickets AS t LEFT JOIN trail ON t.case_id = trail.case_id""",
    {"trail": O.TRAIL},
)
def all_flags(tables):
    counts = audit_rollup(tables.audit, OPTIONS)
    joined = tables.tickets.select("case_id", "root_cause").join(counts, "case_id", "left")
    flags = {**contact_flags(), **mark_flags()}
    return joined.select("case_id", *[column.alias(name) for name, column in flags.items()])


@query(
    "i2_correspondence_bucket",
    """SELECT ticket_case_id AS case_id, count(*) AS logins, CASE WHEN count(*) <= 4 THEN '1 to 3'
    WHEN count(*) <= 10 THEN '4 to 10' WHEN count(*) <= 26 THEN '11 to 25' ELSE '>25' END AS bucket
    FROM concerned GROUP BY ticket_case_id""",
)
def letters_bucket(tables):
    counts = tables.concerned.groupBy(F.col("ticket_case_id").alias("case_id")).agg(
        F.count("*").alias("logins")
    )
    return counts.withColumn("bucket", correspondence_bucket(F.col("logins")))


AGE = f"date_diff('day', create_date, {O.NOW})"


@query(
    "i3_age_bucket",
    f"SELECT case_id, {O.bins(AGE, O.LONG_BINS, 'Above 120')} AS age_days_bucket FROM tickets",
)
def long_ages(tables):
    age = day_boundaries(F.col("create_date"), OPTIONS.run_time())
    return tables.tickets.select("case_id", age_bucket(age).alias("age_days_bucket"))


@query(
    "i4_short_age_bucket",
    f"SELECT case_id, {O.bins(AGE, O.SHORT_BINS, 'Above 15')} AS sev3_age_days_bucket FROM tickets",
)
def short_ages(tables):
    age = day_boundaries(F.col("create_date"), OPTIONS.run_time())
    return tables.tickets.select("case_id", short_age_bucket(age).alias("sev3_age_days_bucket"))


@query(
    "i5_day_ages",
    f"""SELECT case_id, {AGE} AS age_in_days,
    date_diff('day', modified_date, {O.NOW}) AS age_in_modified_days FROM tickets""",
)
def day_ages(tables):
    now = OPTIONS.run_time()
    return tables.tickets.select(
        "case_id",
        day_boundaries(F.col("create_date"), now).alias("age_in_days"),
        day_boundaries(F.col("modified_date"), now).alias("age_in_modified_days"),
    )


@query(
    "i6_calendar_labels",
    """SELECT case_id, concat(year(resolved_date), '-', month(resolved_date)) AS resolved_month,
    concat(year(resolved_date), '-', weekofyear(resolved_date)
        + CASE WHEN dayofweek(resolved_date) = 0 THEN 1 ELSE 0 END) AS resolved_week
    FROM tickets WHERE resolved_date IS NOT NULL""",
)
def calendar_labels(tables):
    return tables.tickets.filter(F.col("resolved_date").isNotNull()).select(
        "case_id",
        month_label("resolved_date").alias("resolved_month"),
        week_label("resolved_date").alias("resolved_week"),
    )


@query(
    "i7_closed_month",
    """SELECT case_id, CASE WHEN status IN ('Resolved', 'Closed')
    THEN date_trunc('month', resolved_date)::TIMESTAMP END AS year_month FROM tickets""",
)
def month_of_closing(tables):
    return tables.tickets.select("case_id", closed_month("resolved_date").alias("year_month"))


@query(
    "i8_case_weight",
    """SELECT t.case_id, coalesce(case_count, 1) AS total_case_count FROM tickets AS t
    LEFT JOIN trail ON t.case_id = trail.case_id""",
    {"trail": O.TRAIL},
)
def weights(tables):
    counts = audit_rollup(tables.audit, OPTIONS).select("case_id", "case_count")
    joined = tables.tickets.select("case_id").join(counts, "case_id", "left")
    return joined.select("case_id", *[c.alias(name) for name, c in case_weight().items()])


@query(
    "i9_sla_age",
    O.view_sql(False, ["sla_days_bucket", "sla_age_bucket"]),
    O.frame(False),
)
def sla_age(tables):
    cases = case_frame(tables, PEOPLE, OPTIONS, resolved=False, parts=["times"])
    age = C.as_days(F.col("ttr_us"))
    return cases.select(
        "case_id", age.alias("sla_days_bucket"), age.alias("sla_age_bucket")
    ).distinct()
