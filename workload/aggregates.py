"""Queries D1 to F1: aggregations, windows and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemetrics.operators.employees import employee_view
from casemetrics.operators.latest import latest_with_ties
from casemetrics.operators.rollup import (
    audit_rollup,
    correspondence_counts,
    last_reopening,
    last_routing,
    quicklink_texts,
)
from casemetrics.plans.ttr_percentiles import (
    load_time,
    mapped_resolved_cases,
    monthly_percentiles,
    weekly_percentiles,
)
from casemetrics.operators.sizing import stored
from workload import oracle as O
from workload.joins import LAST_MARK, bridge_logins, last_marks
from workload.registry import query
from workload.roles import OPTIONS
from workload.views import PERCENTILE_PARTS

TRAIL_PART = {"trail": O.TRAIL}


def rollup_columns(tables, *names):
    return audit_rollup(tables.audit, OPTIONS).select("case_id", *names)


@query(
    "d1_load_time",
    """SELECT status, count(*) AS tickets, max(loaded) AS etl_run_time
    FROM tickets, (SELECT max(dw_last_updated) AS loaded FROM tickets) AS load GROUP BY status""",
)
def latest_load(tables):
    tickets = tables.tickets.withColumn("etl_run_time", load_time(tables))
    return tickets.groupBy("status").agg(
        F.count("*").alias("tickets"), F.max("etl_run_time").alias("etl_run_time")
    )


COUNTS = [
    "routed",
    "pending",
    "reopened",
    "audit_root",
    "four_a",
    "four_r",
    "four_c",
    "four_f",
    "four_na",
    "created_from_quicklink",
    "escalated",
]


@query("d2_conditional_counts", f"SELECT case_id, {', '.join(COUNTS)} FROM trail", TRAIL_PART)
def conditional_counts(tables):
    return rollup_columns(tables, *COUNTS)


@query("d3_first_marks", "SELECT case_id, two_days, five_days FROM trail", TRAIL_PART)
def first_marks(tables):
    return rollup_columns(tables, "two_days", "five_days")


@query("d4_case_count", "SELECT case_id, case_count FROM trail", TRAIL_PART)
def case_count(tables):
    return rollup_columns(tables, "case_count")


@query(
    "d5_greatest_text",
    f"""SELECT case_id, max(to_string) AS quicklink_text FROM audit
    WHERE type = 370 AND {O.IN_TRAIL} GROUP BY case_id""",
)
def greatest_text(tables):
    return quicklink_texts(tables.audit, OPTIONS)


@query(
    "d6_filtered_count",
    "SELECT case_id, letters AS correspondence_count FROM letters",
    {"letters": O.LETTERS},
)
def filtered_count(tables):
    return correspondence_counts(tables.audit, OPTIONS)


@query(
    "d7_shared_filter",
    f"""SELECT case_id, count(*) FILTER (WHERE type = 370) AS created_from_quicklink,
    count(*) FILTER (WHERE type = 20 AND left(to_string, 1) < left(from_string, 1)) AS escalated
    FROM audit WHERE {O.IN_TRAIL} GROUP BY case_id""",
)
def shared_filter(tables):
    """Severity and quicklink events only count when their description is a listed one."""
    return rollup_columns(tables, "created_from_quicklink", "escalated")


@query(
    "d8_distinct_rows",
    """SELECT DISTINCT ticket_case_id AS case_id, concerning_login FROM bridge
    WHERE concerning_login IS NOT NULL AND lower(concerning_login) <> 'none'""",
    {
        "bridge": f"""SELECT ticket_case_id, concerning_login FROM concerned
            WHERE create_date >= {O.time("concerned_from")}"""
    },
)
def distinct_rows(tables):
    return bridge_logins(tables)


@query(
    "e1_rank_latest_snapshot",
    """SELECT employee_login, hr_begin_dt, lower(employee_login) AS login,
    company_country_code AS country FROM headcount WHERE employee_login IS NOT NULL
    QUALIFY rank() OVER (PARTITION BY employee_login ORDER BY hr_begin_dt DESC NULLS FIRST) = 1""",
)
def rank_latest_snapshot(tables):
    view = employee_view(tables.headcount)
    columns = view.select("employee_login", "hr_begin_dt", "login", "country")
    return latest_with_ties(columns, ["employee_login"], "hr_begin_dt")


@query("e2_row_number_latest_mark", LAST_MARK)
def row_number_latest_mark(tables):
    return last_marks(tables)


@query("e3_rank_last_routing", "SELECT * FROM routings", {"routings": O.ROUTINGS})
def rank_last_routing(tables):
    return last_routing(tables.audit, tables.groups, OPTIONS)


@query("e4_rank_last_reopening", "SELECT * FROM reopenings", {"reopenings": O.REOPENINGS})
def rank_last_reopening(tables):
    return last_reopening(tables.audit, tables.groups, OPTIONS)


@query(
    "e5_group_percentiles",
    """SELECT DISTINCT assigned_to_group, 'month' AS period,
        date_trunc('month', resolved_date)::TIMESTAMP AS starts, round(tp90onttr, 9) AS tp90onttr,
        CAST(NULL AS DOUBLE) AS w_tp75onttr, CAST(NULL AS DOUBLE) AS w_tp50onttr,
        CAST(NULL AS DOUBLE) AS w_tp25onttr FROM percentiles
    UNION ALL SELECT DISTINCT assigned_to_group, 'week',
        date_trunc('week', resolved_date)::TIMESTAMP, round(w_tp90onttr, 9), round(w_tp75onttr, 9),
        round(w_tp50onttr, 9), round(w_tp25onttr, 9) FROM percentiles""",
    PERCENTILE_PARTS,
)
def period_percentiles(tables):
    cases = stored(mapped_resolved_cases(tables, OPTIONS))
    months = monthly_percentiles(cases, OPTIONS).withColumnRenamed("resolved_month", "starts")
    weeks = weekly_percentiles(cases, OPTIONS).withColumnsRenamed(
        {"resolved_week": "starts", "w_tp90onttr": "tp90onttr"}
    )
    return months.withColumn("period", F.lit("month")).unionByName(
        weeks.withColumn("period", F.lit("week")), allowMissingColumns=True
    )


@query(
    "f1_top_per_key",
    """SELECT requester_login AS requester, case_id, create_date FROM tickets
    QUALIFY rank() OVER (PARTITION BY requester_login ORDER BY create_date DESC NULLS FIRST) = 1""",
)
def top_per_key(tables):
    cases = tables.tickets.select(F.col("requester_login").alias("requester"), "case_id", "create_date")
    return latest_with_ties(cases, ["requester"], "create_date")
