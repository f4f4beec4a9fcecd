"""Case tables derived from the given tables.

The given tables hold no tickets, so orders play the tickets, lineitems the audit trail and the
concerned people, events the employee snapshots, and nation, region, part and customer the mapping
tables. Every role covers its whole source table. The text below runs in Spark and in DuckDB, so
both sides of a comparison start from the same rows.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from casemetrics.config.options import Options
from casemetrics.config.people import People
from casemetrics.operators.sizing import fits_broadcast, stored
from casemetrics.sources.tables import CaseTables, conform

GROUPS = [
    "ERC Extended Onboarding",
    "Costa Rica ERC Data Management",
    "ERC Onboarding",
    "EMEA ERC Onboarding",
    "Internal Transfers",
    "erc india onboarding",
    "Executive Recruiting",
    "UK ERC Data Management",
    "TAO Team",
    "APAC Extended Onboarding",
    "APAC MNL HRS Benefit",
    "APAC LOA",
    "Manila desk",
    "Shared desk one",
    "Shared desk two",
    "Gulf desk",
    "Beijing desk",
    "Tokyo desk",
    "Costa Rica desk",
    "Six-day desk",
    "Seven-day desk",
    "India desk",
    "Exits desk",
    "Transfers desk",
    "Unlisted desk",
]
CATEGORIES = [
    "EMEA HRS Learning",
    "Human Resources - Belgium",
    "Human Resources - Sweden",
    "Human Resources - Norway",
    "HR Services",
    "Benefits Admin",
]
TYPES = ["New enrollment", "Change", "Question"]
ITEMS = [
    "Instructor-led training",
    "Benefit Support Order",
    "Employee Not Enrolled",
    "Waiting Period (90 Days)",
    "Extended Onboarding",
    "Conversion",
    "General Questions",
    "Payslip",
]
ROOT_CAUSES = [
    "No Defect",
    "Audit finding",
    "PRG Languages BN",
    "Late input",
    "x",
    "Test Ticket - Exclude from metrics",
    "no defect",
    "Wrong form",
    "Unlisted cause",
    "No Defect",
    "No Defect",
]
DETAILS = [
    "Pending documents",
    "Waiting for HR",
    "Future start",
    "LDW moved",
    "Process step",
    "Other",
    "PRG Languages CZ",
    "Follow up",
    "Stop payment",
    "none",
    "HR",
    "nothing",
    "said nothing",
]
RESOLUTIONS = [
    '"Duplicate - True Duplicate"',
    "Others",
    "Others - Insurance Verification form",
    "Enrolled Dependent",
    '"Enrolled -Enrolled Dependent"',
    "Did not Enroll - Employee on LOA",
    "Release - Employee Terminated",
    "Late input",
    "x",
    "Other -Refund Requested",
    "Unknown",
]
LISTED_CAUSES = [
    "No Defect",
    "Audit finding",
    "PRG Languages BN",
    "Late input",
    "Wrong form",
    "LATE INPUT",
]
LISTED_GROUPS = ["No Defect", "HRS Defect", "Training", "Customer", "HRS Defect", "Vendor"]


def _pick(values: list[str], index: str) -> str:
    """SQL for the list entry at ``index``; an index past the end gives an empty text."""
    text = "|".join(values).replace("'", "''")
    return f"split_part('{text}', '|', CAST(1 + {index} AS INT))"


def _step(key: str, divisor: int, modulus: int) -> str:
    return f"CAST(floor({key} / {divisor}) AS BIGINT) % {modulus}"


def _cti(code: str) -> str:
    """Category, type and item of a code from 0 to 143."""
    return f"""{_pick(CATEGORIES, f"({code}) % 6")} AS category,
        {_pick(TYPES, _step(f"({code})", 6, 3))} AS type,
        {_pick(ITEMS, _step(f"({code})", 18, 8))} AS item"""


TICKETS = f"""
SELECT case_id, assigned_to_group, category, type, item, status, create_date,
    CAST(create_date AS DATE) AS create_day, resolved_date,
    CASE WHEN k % 17 <> 0 THEN coalesce(resolved_date, create_date) + INTERVAL '30' HOUR END
        AS modified_date,
    create_date + INTERVAL '2' HOUR AS assigned_date,
    create_date + INTERVAL '72' HOUR AS dw_last_updated,
    CASE WHEN k % 3 = 0 THEN 'U' ELSE 'u' END || CAST(customer % 160 AS STRING) AS requester_login,
    'u' || CAST(k % 170 AS STRING) AS submitted_by,
    CASE k % 40 WHEN 1 THEN 'flx-HRDMIVS' WHEN 2 THEN 'TAO Secondary' WHEN 3 THEN 'seattle1'
        WHEN 4 THEN NULL ELSE 'u' || CAST(customer * 3 % 155 AS STRING) END AS assigned_to_individual,
    CASE WHEN resolved_date IS NULL THEN NULL WHEN k % 41 = 5 THEN 'flx-HRDMIVS'
        ELSE 'U' || CAST(k * 11 % 150 AS STRING) END AS resolved_by,
    'u' || CAST(k * 7 % 150 AS STRING) AS last_modified_by,
    CASE {_step("k", 7, 12)} WHEN 11 THEN NULL ELSE {_pick(ROOT_CAUSES, _step("k", 7, 12))} END
        AS root_cause,
    CASE {_step("k", 11, 14)} WHEN 13 THEN NULL ELSE {_pick(DETAILS, _step("k", 11, 14))} END
        AS root_cause_details,
    CASE {_step("k", 13, 12)} WHEN 11 THEN NULL ELSE {_pick(RESOLUTIONS, _step("k", 13, 12))} END
        AS resolution,
    CASE {_step("k", 5, 4)} WHEN 0 THEN 'Duplicate' WHEN 1 THEN NULL ELSE 'Solved' END
        AS closure_code,
    impact
FROM (
    SELECT o_orderkey AS k, o_custkey AS customer, CAST(o_orderkey AS STRING) AS case_id,
        {_pick(GROUPS, "o_custkey % 25")} AS assigned_to_group,
        {_cti("o_orderkey % 144")},
        CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Closed'
            WHEN o_orderstatus = 'F' THEN 'Resolved' WHEN o_orderstatus = 'O' THEN 'Assigned'
            WHEN o_orderkey % 50 = 7 THEN NULL ELSE 'Pending' END AS status,
        o_orderdate + (o_custkey % 24) * INTERVAL '1' HOUR
            + (o_orderkey % 3600) * INTERVAL '1' SECOND AS create_date,
        CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0
                THEN o_orderdate + (o_custkey % 170) * INTERVAL '1' HOUR
            WHEN o_orderstatus = 'F' OR o_orderkey % 6 = 0
                THEN last_ship + (o_orderkey % 24) * INTERVAL '1' HOUR END AS resolved_date,
        CAST(substring(o_orderpriority, 1, 1) AS INT) AS impact
    FROM orders LEFT JOIN (
        SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey
    ) AS shipped ON o_orderkey = l_orderkey
) AS numbered"""

AUDIT = f"""
SELECT case_id, type,
    CASE e WHEN 8 THEN 'Assigned Group' WHEN 9 THEN 'Pending Reason' WHEN 10 THEN 'Pending Reason'
        WHEN 11 THEN 'Assigned Group' ELSE 'Event' END AS description,
    CASE WHEN type = 20 THEN CAST(1 + part % 5 AS STRING)
        WHEN type = 1 AND supplier % 9 = 0 THEN 'DM-Automation-Queue'
        WHEN part % 4 = 0 THEN NULL ELSE {_pick(GROUPS, "(part % 25)")} END AS from_string,
    CASE WHEN type = 261 THEN CASE supplier % 12 WHEN 0 THEN '2days' WHEN 1 THEN '5 Days'
            WHEN 2 THEN '4A' WHEN 3 THEN '4r' WHEN 4 THEN '4f' WHEN 5 THEN 'Audit check'
            WHEN 6 THEN 'four eye check required' WHEN 7 THEN '5d' WHEN 8 THEN '1000'
            WHEN 9 THEN NULL ELSE CAST(quantity AS STRING) END
        WHEN type = 370 THEN 'https://quicklink/' || CAST(part AS STRING)
        WHEN type = 20 THEN CAST(1 + supplier % 5 AS STRING)
        ELSE {_pick(GROUPS, "(supplier % 25)")} END AS to_string,
    CASE supplier % 6 WHEN 0 THEN 'AR_ESCALATOR' WHEN 1 THEN 'flx-term' WHEN 2 THEN NULL
        ELSE 'u' || CAST(part % 150 AS STRING) END AS created_by,
    {_pick(GROUPS, "(CASE WHEN part % 3 = 0 THEN 22 ELSE supplier % 25 END)")} AS assigned_to,
    event_time AS modified_date, event_time AS create_date, CAST(event_time AS DATE) AS create_day
FROM (
    SELECT CAST(l_orderkey AS STRING) AS case_id, l_partkey AS part, l_suppkey AS supplier,
        CAST(l_quantity AS INT) AS quantity, (l_partkey + l_linenumber) % 12 AS e,
        CASE (l_partkey + l_linenumber) % 12 WHEN 0 THEN 261 WHEN 1 THEN 261 WHEN 2 THEN 184
            WHEN 3 THEN 179 WHEN 4 THEN 179 WHEN 5 THEN 1 WHEN 6 THEN 20 WHEN 7 THEN 370
            WHEN 8 THEN 10 WHEN 9 THEN 10 WHEN 10 THEN 370 ELSE 20 END AS type,
        l_shipdate + (l_partkey % 24) * INTERVAL '1' HOUR AS event_time
    FROM lineitem
) AS numbered"""

HEADCOUNT = """
SELECT CASE WHEN event_id % 20 = 0 THEN 'U' ELSE 'u' END || CAST(user_id AS STRING)
        AS employee_login,
    ts AS hr_begin_dt, 'Department ' || event_type AS department_name,
    CAST(event_id % 90 AS STRING) AS department_id,
    CASE event_id % 5 WHEN 0 THEN 'PHL' WHEN 1 THEN 'CHN' WHEN 2 THEN 'JPN' WHEN 3 THEN 'USA' END
        AS company_country_code,
    'Title ' || CAST(event_id % 8 AS STRING) AS job_title_name,
    'Level ' || CAST(event_id % 9 AS STRING) AS job_level_name,
    CASE WHEN event_id % 2 = 0 THEN 'Ops & Cust Svc' ELSE 'Tech' END AS department_org_level1,
    event_type AS department_org_level2,
    'Supervisor ' || CAST(event_id % 30 AS STRING) AS reports_to_supervisor_employee_name,
    CASE event_id % 7 WHEN 0 THEN 'hrhead' WHEN 1 THEN 'hrhead' WHEN 2 THEN 'cloudlead'
        WHEN 3 THEN 'lawlead' WHEN 4 THEN 'shoplead' WHEN 5 THEN 'hrhead' ELSE 'nobody' END
        AS reports_to_level_2_employee_login,
    'm3' AS reports_to_level_3_employee_login, 'm4' AS reports_to_level_4_employee_login,
    CASE event_id % 11 WHEN 0 THEN 'careLead' WHEN 1 THEN 'seaLead' WHEN 2 THEN 'newLead'
        WHEN 3 THEN 'seaLead' WHEN 4 THEN 'newLead' ELSE 'm5' END AS reports_to_level_5_employee_login,
    CASE event_id % 4 WHEN 0 THEN 'crLead' WHEN 1 THEN 'inLead' WHEN 2 THEN 'inLeadTwo' END
        AS reports_to_level_6_employee_login,
    CASE event_id % 3 WHEN 0 THEN 'clockLead' ELSE 'm7' END AS reports_to_level_7_employee_login,
    'm8' AS reports_to_level_8_employee_login, 'm9' AS reports_to_level_9_employee_login
FROM events"""

CONCERNED = """
SELECT CAST(l_orderkey AS STRING) AS ticket_case_id,
    CASE l_linenumber % 5 WHEN 1 THEN 'None' WHEN 2 THEN NULL
        ELSE 'u' || CAST((l_suppkey * 3 + l_partkey) % 160 AS STRING) END AS concerning_login,
    l_shipdate AS create_date
FROM lineitem"""

GROUP_TABLE = f"""
SELECT {_pick(GROUPS, "n_nationkey")} AS resolver_group,
    CASE WHEN n_nationkey = 24 THEN 0 ELSE 1 END AS report_switch, 'Y' AS hrsd,
    CASE n_nationkey WHEN 12 THEN 'MNL' WHEN 13 THEN 'IND/CRI' WHEN 14 THEN 'CRI/IND'
        WHEN 15 THEN 'DXB10' WHEN 16 THEN 'PEK' WHEN 17 THEN 'HND' WHEN 18 THEN 'CRI'
        WHEN 21 THEN 'IND' ELSE 'S' || CAST(n_nationkey AS STRING) END AS location,
    CASE WHEN n_nationkey % 7 <> 3 THEN 5 + n_nationkey % 3 END AS days_week,
    CASE WHEN r_name = 'EUROPE' THEN 'EMEA' ELSE r_name END AS super_region,
    CASE WHEN n_nationkey % 4 <> 1 THEN 'C' || CAST(n_nationkey AS STRING) END AS country,
    CASE n_nationkey WHEN 12 THEN 'Manila Hubs' ELSE 'Hub ' || CAST(n_regionkey AS STRING) END
        AS delivery_group,
    CASE WHEN n_nationkey = 22 THEN 'Exits' WHEN n_nationkey = 23 THEN 'Transfers'
        WHEN n_nationkey = 20 THEN 'Time and Attendance/CTK' WHEN n_nationkey = 18 THEN 'all'
        WHEN n_nationkey = 15 THEN 'benefits' WHEN n_nationkey % 5 = 2 THEN 'ALL'
        ELSE 'Benefits' END AS dash_process,
    CASE WHEN n_nationkey IN (14, 19) THEN -5 WHEN n_nationkey % 6 = 0 THEN NULL
        ELSE n_nationkey % 6 END AS sla_target,
    CASE WHEN n_nationkey % 4 = 2 THEN 'N' ELSE 'Y' END AS sla_target_exists,
    CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'N' ELSE 'Y' END
        AS defect_scope,
    CASE WHEN n_nationkey % 4 = 0 THEN CAST('1998-01-01' AS TIMESTAMP) END AS defect_launch
FROM nation JOIN region ON n_regionkey = r_regionkey"""

ROOT_CAUSE_TABLE = f"""
SELECT CASE WHEN n_nationkey < 6 THEN {_pick(LISTED_CAUSES, "n_nationkey")}
        ELSE 'Cause ' || CAST(n_nationkey AS STRING) END AS root_cause,
    CASE WHEN n_nationkey < 6 THEN {_pick(LISTED_GROUPS, "n_nationkey")} ELSE n_name END
        AS root_cause_group
FROM nation"""

CTI_PROCESS = f"""
SELECT DISTINCT category, type,
    CASE WHEN c % 3 <> 0 THEN 'P' || CAST(c % 18 AS STRING) END AS country,
    CASE c % 18 % 4 WHEN 0 THEN 'Benefits' WHEN 1 THEN 'BENEFITS' WHEN 2 THEN 'Payroll' END
        AS global_process
FROM (SELECT p_partkey % 18 AS c, {_cti("p_partkey % 18")} FROM part) AS coded"""

CTI_SLAS = f"""
SELECT DISTINCT category, type, item,
    CASE c % 11 WHEN 0 THEN -5 WHEN 1 THEN -1 ELSE 1 + c % 9 END AS sla_target
FROM (SELECT p_partkey * 3 % 144 AS c, {_cti("p_partkey * 3 % 144")} FROM part) AS coded"""

DEFAULT_HUBS = f"""
SELECT DISTINCT upper(category) AS category, type, lower(item) AS item,
    upper({_pick(GROUPS, "g")}) AS resolver_group,
    CASE WHEN g % 2 = 1 OR c % 2 = 0 THEN 'H' || CAST(c % 5 AS STRING) END AS default_hub,
    CASE WHEN c % 3 <> 0 THEN 'Hub group ' || CAST(c % 4 AS STRING) END AS def_hub_group,
    CASE (c + g) % 16 WHEN 0 THEN -5 WHEN 1 THEN -1 WHEN 2 THEN 2 WHEN 3 THEN 8 WHEN 4 THEN 40 END
        AS sla_target
FROM (
    SELECT c_custkey % 25 AS g, c_custkey % 144 AS c, {_cti("c_custkey % 144")} FROM customer
) AS coded"""

TRANSACTIONS = f"""
SELECT DISTINCT assigned_to_group, lower(category) AS category, type, upper(item) AS item,
    assigned_to_group || category || type || item AS grouping,
    CASE WHEN CAST(floor(c / 18) AS BIGINT) % 8 IN (1, 2, 3) THEN 'Benefit Support Order'
        WHEN c % 4 = 0 THEN NULL WHEN c % 4 = 1 THEN 'Claims' ELSE 'Enrolment' END
        AS transaction_type
FROM (
    SELECT p_partkey % 144 AS c, {_pick(GROUPS, "p_partkey % 25")} AS assigned_to_group,
        {_cti("p_partkey % 144")} FROM part
) AS coded"""

ROLE_SQL = {
    "tickets": TICKETS,
    "audit": AUDIT,
    "headcount": HEADCOUNT,
    "concerned": CONCERNED,
    "groups": GROUP_TABLE,
    "root_causes": ROOT_CAUSE_TABLE,
    "cti_process": CTI_PROCESS,
    "cti_slas": CTI_SLAS,
    "default_hubs": DEFAULT_HUBS,
    "transactions": TRANSACTIONS,
}

GIVEN = ["region", "nation", "customer", "part", "orders", "lineitem", "events", "documents"]

# Invented people; the real ones are configuration of whoever runs the views.
PEOPLE = People.of(
    [
        ("hr_head", "hrhead", None),
        ("extended_onboarding_manager", "newlead", None),
        ("attendance_manager", "clocklead", None),
        ("costa_rica_manager", "crlead", None),
        ("india_manager", "inlead", None),
        ("india_manager", "inleadtwo", None),
        ("india_group_manager", "inlead", None),
        ("seattle_manager", "sealead", None),
        ("seattle_assignee", "seattle1", None),
        ("service_leader", "carelead", None),
        ("corporate_leader", "cloudlead", "CLOUD"),
        ("corporate_leader", "lawlead", "LEGAL"),
        ("corporate_leader", "hrhead", "HR"),
        ("consumer_leader", "shoplead", None),
    ]
)

AS_OF = "2001-07-25 12:00:00"

# The given data starts in 1995, so the dates from which data counts lie there too.
DATES = {
    "audit_from": "1995-03-01",
    "correspondence_from": "1995-02-01",
    "concerned_from": "1995-06-01",
    "open_cases_from": "1995-09-01",
    "resolved_cases_from": "1995-10-01",
    "percentiles_from": "1995-08-01",
    "routing_from": "1995-04-01",
    "marks_from": "1995-05-01",
}

OPTIONS = Options(dates=DATES, as_of=dt.datetime.fromisoformat(AS_OF), created_on_day=True)
WIDE_OPTIONS = Options(
    dates=DATES,
    as_of=dt.datetime.fromisoformat(AS_OF),
    scope=("Benefits", "Transfers", "Time and Attendance/CTK"),
)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One role table; only the given tables its text names are opened."""
    text = ROLE_SQL[name]
    sources = {t: given(spark, sf_dir, t) for t in GIVEN if re.search(rf"\b{t}\b", text)}
    for table in sources:
        text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
    return spark.sql(text, **sources)


class RoleTables:
    """Role tables and size checks made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._source = (spark, sf_dir)
        self.fits = _Fits(self)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ROLE_SQL:
            raise AttributeError(name)
        table = conform(role(*self._source, name), name)
        setattr(self, name, table)
        return table


class _Fits(dict):
    def __init__(self, tables: RoleTables) -> None:
        super().__init__()
        self._tables = tables

    def __missing__(self, name: str) -> bool:
        self[name] = fits_broadcast(getattr(self._tables, name))
        return self[name]


class FrameRoles(RoleTables):
    """Role tables for queries that read the tickets many times: they are derived once, when first
    asked for, and stored."""

    def __getattr__(self, name: str) -> DataFrame:
        table = super().__getattr__(name)
        if name == "tickets":
            table = stored(table)
            setattr(self, name, table)
        return table


def case_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    return CaseTables.of(**{name: role(spark, sf_dir, name) for name in ROLE_SQL})


def with_stored_tickets(tables: CaseTables) -> CaseTables:
    """Tickets are a join of the given tables here, and a view reads them many times."""
    return replace(tables, tickets=stored(tables.tickets))


def view_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    return with_stored_tickets(case_tables(spark, sf_dir))
