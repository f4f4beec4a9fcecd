"""Queries A1 to B13: scans, sinks, projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.config import fixed_values as V
from casemetrics.functions.buckets import age_bucket, short_age_bucket
from casemetrics.functions.calendar import day_boundaries, second_label
from casemetrics.functions.clock import END_STATES
from casemetrics.functions.text import contains_any, not_in_or_null
from casemetrics.operators.employees import employee_view
from casemetrics.operators.rollup import correspondence_counts
from casemetrics.operators.sizing import lookup_join
from casemetrics.plans.case_frame import in_scope, open_tickets, resolved_tickets
from casemetrics.plans.ttr_percentiles import load_time, reported_groups
from casemetrics.sources import publish_view
from workload import oracle as O
from workload.registry import given_query, query
from workload.roles import OPTIONS, ROLE_SQL, given
from workload.views import EMPLOYEE_COLUMNS


@query(
    "a1_table_scans",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in ROLE_SQL
    ),
)
def table_scans(tables):
    counts = [
        getattr(tables, name).agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name in ROLE_SQL
    ]
    return reduce(DataFrame.unionAll, counts)


@query(
    "a2_named_intermediates",
    """SELECT super_region, count(*) AS tickets, count(DISTINCT resolver_group) AS groups
    FROM opened JOIN reported ON assigned_to_group = resolver_group GROUP BY super_region""",
    {
        "reported": O.REPORTED,
        "opened": f"""SELECT assigned_to_group FROM tickets WHERE {O.NOT_TEST}
            AND create_day >= {O.date("open_cases_from")} AND status NOT IN ('Resolved', 'Closed')""",
    },
)
def named_intermediates(tables):
    reported = reported_groups(tables.groups).withColumnRenamed("resolver_group", "assigned_to_group")
    opened = open_tickets(tables.tickets, OPTIONS)
    joined = lookup_join(opened, reported, ["assigned_to_group"], tables.fits["groups"], "inner")
    return joined.groupBy("super_region").agg(
        F.count("*").alias("tickets"), F.countDistinct("assigned_to_group").alias("groups")
    )


@query(
    "a3_published_view",
    f"""SELECT case_id, assigned_to_group, status FROM tickets WHERE {O.NOT_TEST}
    AND create_day >= {O.date("open_cases_from")} AND status NOT IN ('Resolved', 'Closed')""",
)
def published_view(tables):
    opened = open_tickets(tables.tickets, OPTIONS)
    return publish_view(opened.select("case_id", "assigned_to_group", "status"), "open_tickets")


@query(
    "b1_employee_projection",
    f"SELECT {EMPLOYEE_COLUMNS} FROM headcount WHERE employee_login IS NOT NULL",
)
def employee_projection(tables):
    return employee_view(tables.headcount).drop("employee_login", "hr_begin_dt")


@query(
    "b2_reported_groups",
    "SELECT resolver_group, location, dash_process FROM groups WHERE report_switch = 1 AND hrsd = 'Y'",
)
def only_reported(tables):
    return reported_groups(tables.groups).select("resolver_group", "location", "dash_process")


@query(
    "b3_not_null",
    "SELECT ticket_case_id, concerning_login FROM concerned WHERE concerning_login IS NOT NULL",
)
def not_null(tables):
    known = tables.concerned.filter(F.col("concerning_login").isNotNull())
    return known.select("ticket_case_id", "concerning_login")


@query(
    "b4_date_cutoffs",
    f"""SELECT 'tickets' AS source, create_day, count(*) AS n FROM tickets
    WHERE create_day >= {O.date("open_cases_from")} GROUP BY create_day
    UNION ALL SELECT 'audit', create_day, count(*) FROM audit
    WHERE create_day > {O.date("audit_from")} GROUP BY create_day""",
)
def date_cutoffs(tables):
    tickets = tables.tickets.filter(F.col("create_day") >= OPTIONS.date("open_cases_from"))
    audit = tables.audit.filter(F.col("create_day") > OPTIONS.date("audit_from"))

    def per_day(df, source):
        return df.groupBy("create_day").agg(F.count("*").alias("n")).withColumn("source", F.lit(source))

    return per_day(tickets, "tickets").unionByName(per_day(audit, "audit"))


@query(
    "b5_in_lists",
    f"""SELECT case_id, status, assigned_to_group, item FROM tickets
    WHERE status NOT IN ('Resolved', 'Closed') AND item NOT IN {O.listing(V.ONBOARDING_ITEMS)}
    AND assigned_to_group IN {O.listing(V.ONBOARDING_GROUPS)}""",
)
def in_lists(tables):
    return tables.tickets.filter(
        ~F.col("status").isin(END_STATES)
        & ~F.col("item").isin(V.ONBOARDING_ITEMS)
        & F.col("assigned_to_group").isin(V.ONBOARDING_GROUPS)
    ).select("case_id", "status", "assigned_to_group", "item")


@query("b6_exclusion_keeps_null", f"SELECT case_id, root_cause FROM tickets WHERE {O.NOT_TEST}")
def exclusion_keeps_null(tables):
    kept = not_in_or_null(F.col("root_cause"), V.TEST_ROOT_CAUSES)
    return tables.tickets.filter(kept).select("case_id", "root_cause")


def _like_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {O.text(w)})" for w in words) + ")"


@given_query(
    "b7_contains_words",
    f"""SELECT doc_id, source, {_like_any("text", V.MISSING_INFO_WORDS)} AS missing_info,
    {_like_any("text", V.PROCESS_WORDS)} AS process_dependency FROM documents""",
)
def contains_words(spark, folder):
    return given(spark, folder, "documents").select(
        "doc_id",
        "source",
        contains_any(F.col("text"), V.MISSING_INFO_WORDS).alias("missing_info"),
        contains_any(F.col("text"), V.PROCESS_WORDS).alias("process_dependency"),
    )


@query(
    "b8_between",
    "SELECT case_id, letters AS correspondence_count FROM letters WHERE letters BETWEEN 2 AND 4",
    {"letters": O.LETTERS},
)
def between(tables):
    counts = correspondence_counts(tables.audit, OPTIONS)
    return counts.filter(F.col("correspondence_count").between(2, 4))


@query(
    "b9_text_range",
    "SELECT case_id, to_string FROM audit WHERE type = 261 AND to_string >= '1' AND to_string <= '9999'",
)
def text_range(tables):
    marks = tables.audit.filter(F.col("type") == V.ROOT_CAUSE_MARK)
    return marks.filter(F.col("to_string").between("1", "9999")).select("case_id", "to_string")


@query(
    "b10_scope_filter",
    f"""SELECT case_id, dash_process AS grp_process, global_process AS cti_process
    FROM tickets AS t LEFT JOIN reported ON assigned_to_group = resolver_group
    LEFT JOIN cti_process AS p ON t.category = p.category AND t.type = p.type
    WHERE {O.NOT_TEST} AND t.resolved_date >= {O.time("resolved_cases_from")}
    AND status IN ('Resolved', 'Closed') AND (lower(dash_process) = 'benefits'
        OR (lower(dash_process) = 'all' AND lower(global_process) = 'benefits'))""",
    {"reported": O.REPORTED},
)
def scope_filter(tables):
    cases = resolved_tickets(tables.tickets, OPTIONS)
    return in_scope(cases, tables, OPTIONS).select("case_id", "grp_process", "cti_process")


@query(
    "b11_severity_raised",
    """SELECT case_id, from_string, to_string FROM audit
    WHERE type = 20 AND from_string IS NOT NULL AND left(to_string, 1) < left(from_string, 1)""",
)
def severity_raised(tables):
    raised = F.substring("to_string", 1, 1) < F.substring("from_string", 1, 1)
    changes = tables.audit.filter((F.col("type") == V.SEVERITY_CHANGE) & raised)
    return changes.select("case_id", "from_string", "to_string")


@query("b12_constant_column", "SELECT case_id, '' AS last_modified_type FROM tickets")
def constant_column(tables):
    return tables.tickets.select("case_id", F.lit("").alias("last_modified_type"))


AGE = f"date_diff('day', t.create_date, {O.NOW})"


@query(
    "b13_reused_columns",
    f"""SELECT case_id, strftime(t.create_date, '%Y-%m-%d %H:%M:%S') AS create_date,
    {AGE} AS age_in_days, {O.bins(AGE, O.LONG_BINS, "Above 120")} AS age_days_bucket,
    {O.bins(AGE, O.SHORT_BINS, "Above 15")} AS sev3_age_days_bucket,
    (SELECT max(dw_last_updated) FROM tickets) AS etl_run_time FROM tickets AS t""",
)
def reused_columns(tables):
    age = F.col("age_in_days")
    aged = tables.tickets.withColumn(
        "age_in_days", day_boundaries(F.col("create_date"), OPTIONS.run_time())
    )
    return aged.select(
        "case_id",
        second_label("create_date").alias("create_date"),
        "age_in_days",
        age_bucket(age).alias("age_days_bucket"),
        short_age_bucket(age).alias("sev3_age_days_bucket"),
        load_time(tables).alias("etl_run_time"),
    )
