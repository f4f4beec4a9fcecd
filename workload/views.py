"""Composite queries K1 to K6."""

from __future__ import annotations

from dataclasses import replace

from casemetrics.operators.employees import latest_employees
from casemetrics.operators.rollup import audit_rollup, last_events
from casemetrics.plans.root_cause_tags import root_cause_tags
from casemetrics.plans.ttr_percentiles import ttr_percentiles
from casemetrics.plans.views import open_case_metrics, resolved_case_metrics
from casemetrics.sources import live_view
from workload import oracle as O
from workload.registry import query
from workload.roles import OPTIONS, PEOPLE, case_tables, view_tables, with_stored_tickets

#: Thresholds so low that the given tables take the ways meant for hot keys and large groups.
HOT_OPTIONS = replace(OPTIONS, hot_rows=3, hot_group_rows=20)
#: The same for the lookups, none of which may be broadcast.
SALTED_OPTIONS = replace(OPTIONS, hot_rows=50, broadcast_rows=0)


@query("k1_open_case_metrics", O.view_sql(False), O.frame(False), view_tables)
def open_cases(tables):
    return open_case_metrics(tables, PEOPLE, OPTIONS)


@query("k2_resolved_case_metrics", O.view_sql(True), O.frame(True), view_tables)
def resolved_cases(tables):
    return resolved_case_metrics(tables, PEOPLE, OPTIONS)


FIVE = ["tp90onttr", "w_tp90onttr", "w_tp75onttr", "w_tp50onttr", "w_tp25onttr"]
PERCENTILE_SQL = (
    "SELECT case_id, assigned_to_group, resolved_date, ttr, "
    + ", ".join(f"round({n}, 9) AS {n}" for n in FIVE)
    + " FROM percentiles"
)
PERCENTILE_PARTS = {
    n: O.BASE[n] for n in ("reported", "mapped_cases", "percentiles")
}


@query("k3_ttr_percentiles", PERCENTILE_SQL, PERCENTILE_PARTS)
def percentiles(tables):
    return ttr_percentiles(tables, OPTIONS)


@query("k4_audit_rollup", "SELECT * FROM trail", {"trail": O.TRAIL})
def rollup(tables):
    return audit_rollup(tables.audit, OPTIONS)


EMPLOYEE_COLUMNS = """date_trunc('month', hr_begin_dt)::TIMESTAMP AS dd_dt,
    lower(employee_login) AS login, department_name AS dept_name, department_id AS dept_id,
    company_country_code AS country, job_title_name AS job_title_nm,
    job_level_name AS job_lvl_nm, department_org_level1 AS dept_org_level1,
    department_org_level2 AS dept_org_level2,
    reports_to_supervisor_employee_name AS reports_to_supervisor, """ + ", ".join(
    f"upper(reports_to_level_{n}_employee_login) AS reports_to_level{n}_login" for n in range(2, 10)
)
LATEST_EMPLOYEES = f"""SELECT {EMPLOYEE_COLUMNS}
FROM headcount WHERE employee_login IS NOT NULL
QUALIFY rank() OVER (PARTITION BY employee_login ORDER BY hr_begin_dt DESC NULLS FIRST) = 1"""


@query("k5_latest_employees", LATEST_EMPLOYEES)
def employees(tables):
    return latest_employees(tables.headcount)


LAST_EVENTS = """SELECT case_id, 'routing' AS event, routed_date AS event_time, routed_to AS detail
    FROM routings
    UNION ALL SELECT case_id, 'reopening', last_reopened_date, reopened_by_system FROM reopenings"""


@query(
    "k6_last_routing_and_reopening", LAST_EVENTS, {"routings": O.ROUTINGS, "reopenings": O.REOPENINGS}
)
def routings_and_reopenings(tables):
    return last_events(tables.audit, tables.groups, OPTIONS)


@query("k1_hot_keys", O.view_sql(False), O.frame(False), view_tables)
def open_cases_salted(tables):
    return open_case_metrics(tables, PEOPLE, SALTED_OPTIONS)


@query("k2_hot_keys", O.view_sql(True), O.frame(True), view_tables)
def resolved_cases_hot(tables):
    return resolved_case_metrics(tables, PEOPLE, HOT_OPTIONS)


@query("k3_counting_search", PERCENTILE_SQL, PERCENTILE_PARTS)
def percentiles_by_counting(tables):
    return ttr_percentiles(tables, HOT_OPTIONS)


@query("k6_hot_keys", LAST_EVENTS, {"routings": O.ROUTINGS, "reopenings": O.REOPENINGS})
def last_events_hot(tables):
    return last_events(tables.audit, tables.groups, HOT_OPTIONS)


@query(
    "k1_live_view",
    O.view_sql(False),
    O.frame(False),
    case_tables,
)
def live_open_cases(tables):
    return live_view("open_case_metrics", lambda: open_case_metrics(with_stored_tickets(tables), PEOPLE, OPTIONS)).read()


@query("k7_root_cause_tags", "SELECT case_id, root_cause_tag FROM tags", {"tags": O.TAGS})
def tags(tables):
    return root_cause_tags(tables, OPTIONS)
