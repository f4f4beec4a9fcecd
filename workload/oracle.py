"""Comparison SQL for the composite queries, written against the role tables."""

from __future__ import annotations

from casemetrics.config import fixed_values as V
from workload.roles import AS_OF, DATES

NOW = f"TIMESTAMP '{AS_OF}'"
DAY = 86_400_000_000


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def date(name: str) -> str:
    return f"DATE '{DATES[name]}'"


def time(name: str) -> str:
    return f"TIMESTAMP '{DATES[name]}'"


def clock(ts: str, days: int = 5, anchor: str = "1970-01-05") -> str:
    """Working microseconds since the anchor: whole weeks, then the capped rest of the week."""
    us = f"date_diff('microsecond', TIMESTAMP '{anchor}', {ts})"
    return f"(({us} // {7 * DAY}) * {days * DAY} + least({us} % {7 * DAY}, {days * DAY}))"


def span(start: str, end: str, days: int = 5, anchor: str = "1970-01-05") -> str:
    return f"({clock(end, days, anchor)} - {clock(start, days, anchor)})"


def in_days(us: str) -> str:
    return f"{us} / {DAY}.0"


BEIJING = "('PEK2', 'PEK10', 'PEK', 'HND', 'HND11', 'JPN', 'CHN')"
BEIJING_OR_MANILA = "('PEK2', 'PEK10', 'PEK', 'HND', 'HND11', 'JPN', 'CHN', 'MNL')"


def taken(sites: str, start: str, end: str, location: str = "location", week: str = "days_week") -> str:
    eight = "INTERVAL '8' HOUR"
    return f"""CASE WHEN {location} = 'DXB10' THEN {span(start, end, 5, "1970-01-04")}
        WHEN {location} IN {sites} THEN {span(f"{start} + {eight}", f"{end} + {eight}")}
        WHEN {week} = 6 THEN {span(start, end, 6)} WHEN {week} = 7 THEN {span(start, end, 7)}
        ELSE {span(start, end)} END"""


NOT_TEST = f"(root_cause IS NULL OR root_cause NOT IN {listing(V.TEST_ROOT_CAUSES)})"
REPORTED = "SELECT * FROM groups WHERE report_switch = 1 AND hrsd = 'Y'"
IN_TRAIL = f"""create_day > {date("audit_from")}
    AND (type IN (261, 184) OR description IN ('Assigned Group', 'Pending Reason'))"""
IS_LETTER = f"""create_day > {date("correspondence_from")} AND type = 179"""

EMPLOYEES = """
SELECT lower(employee_login) AS login, company_country_code AS country,
    department_org_level1 AS department, reports_to_supervisor_employee_name AS supervisor,
    upper(reports_to_level_2_employee_login) AS l2, upper(reports_to_level_5_employee_login) AS l5,
    upper(reports_to_level_6_employee_login) AS l6, upper(reports_to_level_7_employee_login) AS l7
FROM headcount WHERE employee_login IS NOT NULL
QUALIFY rank() OVER (PARTITION BY employee_login ORDER BY hr_begin_dt DESC NULLS FIRST) = 1"""

PERSONS = """
SELECT *, CASE WHEN l5 = 'CARELEAD' THEN 'CS' WHEN l2 = 'CLOUDLEAD' THEN 'CLOUD'
    WHEN l2 = 'LAWLEAD' THEN 'LEGAL' WHEN l2 = 'HRHEAD' THEN 'HR'
    WHEN l2 = 'SHOPLEAD' AND department <> 'Ops & Cust Svc' THEN 'WW_CONSUMER' END AS line
FROM employees"""

COUNT_MARK = f"""CASE WHEN type = 261 AND to_string >= '1' AND to_string <= '9999'
        AND lower(to_string) NOT IN {listing(V.NOT_COUNTS)} AND created_by <> 'AR_ESCALATOR'
        AND length(to_string) < 4 AND regexp_full_match(trim(to_string), '[0-9]+')
    THEN CAST(trim(to_string) AS INTEGER) END"""


def mark(labels) -> str:
    return f"type = 261 AND lower(to_string) IN {listing(labels)}"


TRAIL = f"""
SELECT case_id,
    count(*) FILTER (WHERE {mark(V.FOUR_A_MARKS)}) AS four_a,
    count(*) FILTER (WHERE {mark(V.FOUR_R_MARKS)}) AS four_r,
    count(*) FILTER (WHERE {mark(V.FOUR_C_MARKS)}) AS four_c,
    count(*) FILTER (WHERE {mark(V.FOUR_F_MARKS)}) AS four_f,
    count(*) FILTER (WHERE {mark(V.FOUR_NA_MARKS)}) AS four_na,
    count(*) FILTER (WHERE description = 'Assigned Group' AND from_string IS NOT NULL) AS routed,
    count(*) FILTER (WHERE description = 'Pending Reason') AS pending,
    count(*) FILTER (WHERE type = 184) AS reopened,
    count(*) FILTER (WHERE type = 261 AND contains(lower(to_string), 'audit')) AS audit_root,
    count(*) FILTER (WHERE type = 370) AS created_from_quicklink,
    min(CASE WHEN {mark(V.TWO_DAY_MARKS)} THEN modified_date ELSE TIMESTAMP '2099-01-01' END)
        AS two_days,
    min(CASE WHEN {mark(V.FIVE_DAY_MARKS)} THEN modified_date ELSE TIMESTAMP '2099-01-01' END)
        AS five_days,
    max({COUNT_MARK}) AS case_count,
    count(*) FILTER (WHERE type = 20 AND substring(to_string, 1, 1) < substring(from_string, 1, 1))
        AS escalated,
    max(to_string) FILTER (WHERE type = 370) AS quicklink_text
FROM audit WHERE {IN_TRAIL} GROUP BY case_id"""

LETTERS = f"SELECT case_id, count(*) AS letters FROM audit WHERE {IS_LETTER} GROUP BY case_id"

ROUTINGS = f"""
SELECT case_id, assigned_to, from_string AS routed_from, to_string AS routed_to,
    create_date AS routed_date
FROM audit WHERE type = 1 AND create_date >= {time("routing_from")}
    AND from_string <> 'DM-Automation-Queue'
    AND to_string IN (SELECT resolver_group FROM groups WHERE dash_process = 'Benefits')
QUALIFY rank() OVER (PARTITION BY case_id ORDER BY create_date DESC NULLS FIRST) = 1"""

REOPENINGS = f"""
SELECT case_id, CASE WHEN created_by = 'flx-term' THEN 'Y' ELSE 'N' END AS reopened_by_system,
    create_date AS last_reopened_date
FROM audit WHERE type = 184 AND create_date >= {time("routing_from")}
    AND assigned_to IN (SELECT resolver_group FROM groups WHERE dash_process = 'Exits')
QUALIFY rank() OVER (PARTITION BY case_id ORDER BY create_date DESC NULLS FIRST) = 1"""

TAGS = f"""
SELECT case_id, to_string AS root_cause_tag FROM audit
WHERE type = 261 AND create_day >= {date("marks_from")}
    AND case_id IN (SELECT case_id FROM tickets WHERE resolved_date >= {time("marks_from")})
QUALIFY row_number() OVER (PARTITION BY case_id
    ORDER BY modified_date DESC NULLS FIRST, to_string DESC NULLS FIRST) = 1"""

RECENT = f"""
SELECT assigned_to_individual AS login,
    bool_or(assigned_to_group = 'ERC Extended Onboarding') AS extended,
    bool_or(assigned_to_group <> 'ERC Extended Onboarding') AS onboarding
FROM tickets WHERE assigned_to_individual IS NOT NULL
    AND assigned_to_group IN {listing(["ERC Extended Onboarding", *V.ONBOARDING_GROUPS])}
    AND CAST(resolved_date AS DATE) BETWEEN CAST({NOW} AS DATE) - 30 AND CAST({NOW} AS DATE) - 1
GROUP BY ALL"""

MAPPED_CASES = f"""
SELECT DISTINCT t.case_id, t.assigned_to_group, t.resolved_date,
    {taken(BEIJING, "t.create_date", "t.resolved_date")} / {DAY}.0 AS ttr
FROM tickets AS t LEFT JOIN reported AS g ON t.assigned_to_group = g.resolver_group
WHERE t.assigned_to_group || t.category || t.type || t.item IN (SELECT grouping FROM transactions)
    AND t.resolved_date >= {time("percentiles_from")} AND t.status IN ('Resolved', 'Closed')
    AND {NOT_TEST}"""

PERCENTILES = """
SELECT *, quantile_cont(ttr, 0.9) OVER by_month AS tp90onttr,
    quantile_cont(ttr, 0.9) OVER by_week AS w_tp90onttr,
    quantile_cont(ttr, 0.75) OVER by_week AS w_tp75onttr,
    quantile_cont(ttr, 0.5) OVER by_week AS w_tp50onttr,
    quantile_cont(ttr, 0.25) OVER by_week AS w_tp25onttr
FROM mapped_cases
WINDOW by_month AS (PARTITION BY assigned_to_group, date_trunc('month', resolved_date)),
    by_week AS (PARTITION BY assigned_to_group, date_trunc('week', resolved_date))"""

PEOPLE_CONCERNED = f"""
SELECT DISTINCT b.ticket_case_id AS case_id, p.country, p.line
FROM concerned AS b LEFT JOIN persons AS p ON lower(b.concerning_login) = p.login
WHERE b.create_date >= {time("concerned_from")} AND lower(b.concerning_login) <> 'none'"""

BASE = {
    "reported": REPORTED,
    "employees": EMPLOYEES,
    "persons": PERSONS,
    "trail": TRAIL,
    "letters": LETTERS,
    "routings": ROUTINGS,
    "reopenings": REOPENINGS,
    "recent": RECENT,
    "mapped_cases": MAPPED_CASES,
    "percentiles": PERCENTILES,
    "people_concerned": PEOPLE_CONCERNED,
}


def _joined(resolved: bool, scope: tuple[str, ...]) -> str:
    """All tickets of a view with every table joined and short flags computed."""
    processes = listing([s.lower() for s in scope])
    if resolved:
        chosen = f"""t.resolved_date >= {time("resolved_cases_from")}
            AND t.status IN ('Resolved', 'Closed')"""
        end = "t.resolved_date"
    else:
        chosen = f"""t.create_day >= {date("open_cases_from")}
            AND t.status NOT IN ('Resolved', 'Closed')"""
        end = "(SELECT max(dw_last_updated) FROM tickets)"
    return f"""
SELECT t.*, g.location, g.super_region, g.country AS group_country, g.delivery_group AS hub_name,
    g.dash_process, g.sla_target AS group_target, g.sla_target_exists AS group_has_sla,
    g.defect_scope, g.defect_launch, ctp.country AS cti_country, ctp.global_process,
    cts.sla_target AS cti_target, dh.default_hub, dh.def_hub_group, dh.sla_target AS hub_target,
    tt.transaction_type AS mapped_type, cause.root_cause AS cause_name,
    again.root_cause AS cause_again, again.root_cause_group AS cause_group,
    reason.root_cause AS reason_name, trail.* EXCLUDE (case_id), letters.letters,
    routings.routed_date, reopenings.reopened_by_system, reopenings.last_reopened_date,
    tp.tp90onttr AS month_percentile, coalesce(recent.extended, FALSE) AS by_extended,
    coalesce(recent.onboarding, FALSE) AS by_onboarding,
    req.country AS req_country, req.line AS req_line, req.l5 AS req_l5, ass.country AS ass_country,
    ass.l5 AS ass_l5, ass.l6 AS ass_l6, ass.supervisor, rsv.country AS rsv_country,
    rsv.l6 AS rsv_l6, sub.l7 AS sub_l7, con.country AS con_country, con.line AS con_line,
    {taken(BEIJING_OR_MANILA, "t.create_date", end, "g.location", "g.days_week")} AS shown_us,
    {taken(BEIJING, "t.create_date", end, "g.location", "g.days_week")} AS judged_us,
    {span("t.create_date", "t.resolved_date")} AS order_us,
    {span("t.create_date", "trail.two_days")} AS stage_one_us,
    {span("trail.two_days", "trail.five_days")} AS stage_two_us,
    {span("t.create_date", "routings.routed_date", 7)} AS to_routing_us,
    {span("t.create_date", "reopenings.last_reopened_date", 7)} AS to_reopening_us,
    (SELECT max(dw_last_updated) FROM tickets) AS loaded
FROM tickets AS t
JOIN reported AS g ON t.assigned_to_group = g.resolver_group
LEFT JOIN cti_process AS ctp ON (t.category, t.type) = (ctp.category, ctp.type)
LEFT JOIN cti_slas AS cts ON (t.category, t.type, t.item) = (cts.category, cts.type, cts.item)
LEFT JOIN default_hubs AS dh ON lower(concat_ws('~', t.category, t.type, t.item, t.assigned_to_group))
    = lower(concat_ws('~', dh.category, dh.type, dh.item, dh.resolver_group))
LEFT JOIN transactions AS tt ON t.assigned_to_group = tt.assigned_to_group
    AND lower(concat_ws('~', t.category, t.type, t.item))
        = lower(concat_ws('~', tt.category, tt.type, tt.item))
LEFT JOIN root_causes AS cause ON lower(t.root_cause) = lower(cause.root_cause)
LEFT JOIN root_causes AS again ON lower(t.root_cause) = lower(again.root_cause)
LEFT JOIN root_causes AS reason ON lower(t.resolution) = lower(reason.root_cause)
LEFT JOIN trail ON t.case_id = trail.case_id
LEFT JOIN letters ON t.case_id = letters.case_id
LEFT JOIN routings ON (t.case_id, t.assigned_to_group) = (routings.case_id, routings.routed_to)
LEFT JOIN reopenings ON t.case_id = reopenings.case_id
LEFT JOIN percentiles AS tp ON t.case_id = tp.case_id
LEFT JOIN recent ON t.submitted_by = recent.login
LEFT JOIN persons AS req ON lower(t.requester_login) = req.login
LEFT JOIN persons AS ass ON lower(t.assigned_to_individual) = ass.login AND ass.l2 = 'HRHEAD'
LEFT JOIN persons AS rsv ON lower(t.resolved_by) = rsv.login AND rsv.l2 = 'HRHEAD'
LEFT JOIN persons AS sub ON lower(t.submitted_by) = sub.login AND sub.l2 = 'HRHEAD'
LEFT JOIN people_concerned AS con ON t.case_id = con.case_id
WHERE {chosen} AND {NOT_TEST.replace("root_cause", "t.root_cause")}
    AND (lower(g.dash_process) IN {processes}
        OR (lower(g.dash_process) = 'all' AND lower(ctp.global_process) IN {processes}))"""


def _flagged(scope: tuple[str, ...]) -> str:
    """One boolean per question of the SLA rules."""
    onboarding = listing(V.ONBOARDING_GROUPS)
    any_onboarding = listing(
        [*V.ONBOARDING_GROUPS, "ERC Extended Onboarding", "erc india onboarding"]
    )
    hour = 3_600_000_000
    wide = "TRUE" if "Time and Attendance/CTK" in scope else "FALSE"
    order = "coalesce(mapped_type = 'Benefit Support Order', FALSE)"
    return f"""
SELECT *, -5 IN (coalesce(cti_target, 0), coalesce(group_target, 0), coalesce(hub_target, 0)) AS staged,
    coalesce(two_days, TIMESTAMP '2099-01-01') = TIMESTAMP '2099-01-01'
        AND coalesce(five_days, TIMESTAMP '2099-01-01') = TIMESTAMP '2099-01-01' AS unmarked,
    stage_one_us <= {48 * hour} AND stage_two_us <= {120 * hour} AS stages_kept,
    stage_one_us > {48 * hour} OR stage_two_us > {120 * hour} AS stages_missed,
    assigned_to_group = 'ERC Extended Onboarding' AND req_l5 = 'NEWLEAD' AS managed,
    assigned_to_group IN {listing(V.AUDITED_GROUPS)}
        AND (contains(lower(root_cause), 'audit') OR audit_root > 0) AS audited,
    (assigned_to_group = 'ERC Extended Onboarding' AND by_extended)
        OR (assigned_to_group IN {onboarding} AND by_onboarding) AS own_staff,
    assigned_to_group IN {any_onboarding} AND closure_code = 'Duplicate' AS duplicate,
    {wide} AND lower(dash_process) = 'time and attendance/ctk' AND sub_l7 = 'CLOCKLEAD' AS attendance,
    assigned_to_group = 'ERC Onboarding' AND item NOT IN {listing(V.ONBOARDING_ITEMS)} AS foreign_item,
    assigned_to_group IN {listing(V.RECRUITING_GROUPS)} AND impact = 2 AS recruiting,
    category = 'EMEA HRS Learning' AND type = 'New enrollment' AND item = 'Instructor-led training'
        AND (root_cause IN {listing(V.COURSE_CAUSES)} OR root_cause_details IN {listing(V.COURSE_CAUSES)})
        AS course,
    assigned_to_group = 'UK ERC Data Management' AND impact IN (2, 3) AS uk_data,
    assigned_to_group = 'TAO Team' AND impact IN (3, 4) AS tao,
    impact = 3 AND location NOT IN ('IND', 'HYD') AS one_day,
    {order} AND item = 'Waiting Period (90 Days)' AS waiting,
    {order} AND item = 'Employee Not Enrolled' AS missing_employee,
    {order} AND item = 'Benefit Support Order' AS plain_order,
    order_us <= {480 * hour} AS short_order, order_us <= {960 * hour} AS long_order,
    resolution IN {listing(V.DUPLICATE_RESOLUTIONS)} AS twice,
    resolution IN {listing(V.DUPLICATE_RESOLUTIONS + V.FURTHER_DUPLICATE_RESOLUTIONS)} AS twice_or_more,
    resolution IN {listing(V.ENROLLED_RESOLUTIONS)} AS enrolled,
    resolution IN {listing(V.ENROLLED_WITH_TARGET)} AS enrolled_target,
    resolution IN {listing(V.NO_TARGET_RESOLUTIONS)} AS without_target,
    resolution IN {listing(V.NO_ENROLMENT_RESOLUTIONS)} AS without_enrolment,
    coalesce(defect_scope, 'N') = 'Y' AND NOT coalesce(resolved_date < defect_launch, FALSE) AS defects,
    location IN ('IND/CRI', 'CRI/IND') AS shared,
    assigned_to_individual = 'flx-HRDMIVS' OR resolved_by = 'flx-HRDMIVS' AS robot,
    coalesce(root_cause, 'x') = 'x' AS no_cause, coalesce(resolution, 'x') = 'x' AS no_resolution
FROM joined"""


def frame(resolved: bool, scope: tuple[str, ...] = ("Benefits",)) -> dict[str, str]:
    """Named intermediates up to ``judged``, which adds the SLA results."""
    target = "WHEN one_day THEN 1 ELSE 2 END" if resolved else "ELSE 2 END"
    orders_met = """WHEN waiting THEN '-' WHEN missing_employee AND long_order THEN 'Y'
        WHEN missing_employee AND twice_or_more THEN '-'
        WHEN plain_order AND without_enrolment AND short_order THEN 'Y'
        WHEN plain_order AND resolution IS NULL AND short_order THEN 'Y'
        WHEN plain_order AND twice THEN '-' WHEN plain_order AND enrolled AND long_order THEN 'Y'"""
    orders_value = """WHEN waiting THEN -1 WHEN missing_employee THEN 40
        WHEN plain_order AND without_enrolment THEN 20
        WHEN plain_order AND resolution IS NULL THEN 20 WHEN plain_order AND twice_or_more THEN -1
        WHEN plain_order AND enrolled THEN 40"""
    orders_exist = """WHEN waiting THEN 'N' WHEN missing_employee THEN 'Y'
        WHEN plain_order AND without_enrolment THEN 'Y'
        WHEN plain_order AND resolution IS NULL AND short_order THEN 'Y'
        WHEN plain_order AND without_target THEN 'N' WHEN plain_order AND enrolled_target THEN 'Y'"""
    if not resolved:
        orders_met = orders_value = orders_exist = ""
    exempt = "own_staff OR duplicate OR attendance OR foreign_item"
    judged = f"""
SELECT *, CASE {orders_value} WHEN staged AND unmarked THEN -1 WHEN staged THEN -5
        WHEN managed THEN -1 WHEN uk_data THEN 1 WHEN audited THEN -1 WHEN {exempt} THEN -1
        WHEN recruiting THEN 1 WHEN course THEN 7 WHEN tao THEN impact - 2
        WHEN hub_target IS NOT NULL THEN hub_target WHEN cti_target IS NOT NULL THEN cti_target
        WHEN group_has_sla = 'N' THEN -1 WHEN group_target IS NOT NULL THEN group_target
        {target} AS sla_taget_value,
    CASE {orders_exist} WHEN staged AND unmarked THEN 'N' WHEN staged THEN 'Y'
        WHEN cti_target = -1 OR hub_target = -1 THEN 'N' WHEN managed OR audited THEN 'N'
        WHEN {exempt} THEN 'N' WHEN cti_target > 0 OR hub_target > 0 THEN 'Y'
        WHEN group_has_sla = 'N' THEN 'N' ELSE 'Y' END AS sla_target_exists,
    CASE {orders_met} WHEN managed THEN '-' WHEN staged AND unmarked THEN '-'
        WHEN staged AND stages_kept THEN 'Y' WHEN staged AND stages_missed THEN 'N'
        WHEN audited THEN '-' WHEN hub_target = -1 OR cti_target = -1 THEN '-'
        WHEN {exempt} THEN '-'
        WHEN group_has_sla = 'N' AND cti_target IS NULL AND hub_target IS NULL THEN '-'
        WHEN judged_us IS NULL THEN NULL WHEN judged_us > effective * {DAY} THEN 'N' ELSE 'Y' END
        AS sla_target_met
FROM (
    SELECT *, CASE WHEN recruiting THEN 1 WHEN course THEN 7 WHEN uk_data THEN 1
        WHEN tao THEN impact - 2 WHEN hub_target IS NOT NULL THEN hub_target
        WHEN cti_target IS NOT NULL THEN cti_target WHEN group_target IS NOT NULL THEN group_target
        {target} AS effective
    FROM flagged
) AS aimed"""
    return {**BASE, "joined": _joined(resolved, scope), "flagged": _flagged(scope), "judged": judged}


def _person_rules() -> dict[str, str]:
    managed = lambda *names: " OR ".join(
        f"{who}_l6 IN {listing(names)}" for who in ("ass", "rsv")
    )
    in_country = lambda code: f"(ass_country = '{code}' OR rsv_country = '{code}')"
    return {
        "resolver_country": f"""CASE
            WHEN lower(assigned_to_group) IN {listing(V.CTI_COUNTRY_GROUPS)} AND cti_country IS NOT NULL
                THEN cti_country
            WHEN category LIKE '%- Belgium' THEN 'BEL' WHEN category LIKE '%- Sweden' THEN 'SWE'
            WHEN category LIKE '%- Norway' THEN 'NOR'
            ELSE coalesce(group_country, con_country, req_country, 'Unmapped') END""",
        "delivery_location": f"""CASE
            WHEN hub_name = 'Manila Hubs' AND {in_country("PHL")} THEN 'MNL'
            WHEN hub_name = 'Manila Hubs' AND {in_country("CHN")} THEN 'CHN'
            WHEN hub_name = 'Manila Hubs' AND {in_country("JPN")} THEN 'JPN'
            WHEN shared AND ({managed("CRLEAD")}) THEN 'CRI'
            WHEN shared AND ({managed("INLEAD", "INLEADTWO")}) THEN 'IND' WHEN robot THEN 'IND'
            WHEN assigned_to_individual IN ('seattle1', 'TAO Secondary') THEN 'SEA'
            WHEN shared AND ass_l5 = 'SEALEAD' THEN 'SEA'
            WHEN shared THEN coalesce(default_hub, 'SEA') ELSE location END""",
        "delivery_group": f"""CASE WHEN shared AND ({managed("CRLEAD")}) THEN 'Costa Rica Hub'
            WHEN shared AND ({managed("INLEAD")}) THEN 'India Hubs' WHEN robot THEN 'India Hubs'
            WHEN shared THEN coalesce(def_hub_group, 'Other') ELSE hub_name END""",
        "lob1": """CASE coalesce(con_line, req_line, 'OPS') WHEN 'CS' THEN 'CS' WHEN 'OPS' THEN 'OPS'
            ELSE 'CORP' END""",
        "lob2": "coalesce(con_line, req_line, 'OPS')",
    }


def _case_rules(resolved: bool) -> dict[str, str]:
    mapped = "coalesce(mapped_type, 'Other')"
    at_cri = f"CASE WHEN location = 'CRI' THEN 'Benefits Administration' ELSE {mapped} END"
    week = "weekofyear(resolved_date) + CASE dayofweek(resolved_date) WHEN 0 THEN 1 ELSE 0 END"
    year = "CAST(year(resolved_date) AS VARCHAR) || '-' ||"
    return {
        "transaction_type": mapped if resolved else at_cri,
        "correspondence_bucket": """CASE WHEN letters <= 4 THEN '1 to 3' WHEN letters <= 10 THEN '4 to 10'
            WHEN letters <= 26 THEN '11 to 25' WHEN letters > 25 THEN '>25' END""",
        "resolved_month": f"{year} CAST(month(resolved_date) AS VARCHAR)",
        "resolved_week": f"{year} CAST({week} AS VARCHAR)",
        "root_cause_defect": """CASE WHEN NOT defects THEN 'Not Defect Scope' WHEN no_cause THEN 'Blank'
            ELSE coalesce(cause_name, 'Other root cause') END""",
        "fcr": "CASE WHEN reopened > 0 OR routed > 0 OR pending > 0 THEN 'N' ELSE 'Y' END",
        "process": """CASE
            WHEN assigned_to_group IN ('APAC Extended Onboarding', 'ERC Extended Onboarding') THEN 'EOB'
            WHEN super_region = 'EMEA' AND item = 'Extended Onboarding' THEN 'EOB'
            WHEN dash_process = 'ALL' THEN coalesce(global_process, 'Other') ELSE dash_process END""",
    }


def _any_word(words) -> str:
    return "(" + " OR ".join(f"contains(lower(root_cause_details), {text(w)})" for w in words) + ")"


ROOT_CAUSE_GROUP = f"""CASE WHEN reason_name IS NOT NULL THEN reason_name
    WHEN dash_process = 'Transfers' AND no_resolution THEN 'Blank' WHEN no_cause THEN 'Blank'
    WHEN cause_again IS NULL OR dash_process = 'Transfers' THEN 'Other root cause'
    WHEN root_cause <> 'No Defect' THEN
        CASE WHEN cause_group IN ('HRS Defect', 'No Defect') THEN 'Lifecycle Defect' ELSE cause_group END
    WHEN {_any_word(V.MISSING_INFO_WORDS)} THEN 'Missing Info'
    WHEN {_any_word(V.PROCESS_WORDS)} THEN 'Process Dependency'
    WHEN to_routing_us > sla_taget_value * {DAY} THEN 'Routed_After_SLA_Lapse'
    WHEN to_reopening_us > sla_taget_value * {DAY} THEN
        CASE reopened_by_system WHEN 'Y' THEN 'Reopened_Sys_After_SLA_Lapse'
            ELSE 'Reopened_Pers_After_SLA_Lapse' END
    WHEN pending > 0 THEN 'Missing Info' ELSE 'Lifecycle Defect' END"""


def bins(value: str, edges: list[tuple[int, str]], above: str) -> str:
    cases = " ".join(f"WHEN {value} < {edge} THEN '{label}'" for edge, label in edges)
    return f"CASE {cases} WHEN {value} IS NOT NULL THEN '{above}' END"


LONG_BINS = [
    (5, "0 to 5"), (11, "05 to 10"), (16, "11 to 15"), (21, "16 to 20"), (26, "21 to 25"),
    (31, "26 to 30"), (61, "31 to 60"), (91, "61 to 90"), (121, "91 to 120"),
]
SHORT_BINS = [(3, "0 to 2"), (6, "3 to 5"), (9, "6 to 8"), (12, "9 to 11"), (15, "12 to 14")]


def _yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'Y' ELSE 'N' END"


def columns(resolved: bool) -> dict[str, str]:
    """Every column of a view as SQL over ``judged``."""
    as_is = """case_id assigned_to_group category type item closure_code requester_login submitted_by
        assigned_to_individual resolved_by sla_target_met sla_taget_value sla_target_exists
        root_cause_details assigned_date""".split()
    age = f"date_diff('day', create_date, {NOW})"
    found = {
        **{name: name for name in as_is},
        **_person_rules(),
        **_case_rules(resolved),
        "superregion": "super_region",
        "correspondence_count": "letters",
        "create_date": "strftime(create_date, '%Y-%m-%d %H:%M:%S')",
        "resolved_date_time": "strftime(resolved_date, '%Y-%m-%d %H:%M:%S')",
        "resolved_date": "CAST(resolved_date AS DATE)",
        "ttr": in_days("abs(shown_us)"),
        "total_case_count": "coalesce(case_count, 1)",
        "reopened": _yes("reopened > 0"),
        "routed": _yes("routed > 0"),
        "pending": _yes("pending > 0"),
        "country": "group_country",
        "hrs_supervisor": "supervisor",
    }
    month = "date_trunc('month', resolved_date)::TIMESTAMP"
    if resolved:
        return {
            **found,
            "resolution": "resolution",
            "tp90onttr": "round(month_percentile, 9)",
            "year_month": month,
            "escalated": _yes("escalated > 0"),
            "4a": _yes("four_a > 0"),
            "4r": _yes("four_r > 0"),
            "4c": _yes("four_c > 0"),
            "4f": _yes("four_f > 0"),
            "root_cause_group": ROOT_CAUSE_GROUP,
            "created_from_quicklink": _yes("created_from_quicklink > 0"),
            "quicklink_id": "ltrim(quicklink_text, 'htps:/.amzoncquikl')",
            "defect": "CASE WHEN root_cause = 'No Defect' THEN 'N' ELSE 'Y' END",
        }
    return {
        **found,
        "last_modified_type": "''",
        "tp90onttr": "CAST(NULL AS DOUBLE)",
        "year_month": "CAST(NULL AS TIMESTAMP)",
        "sla_days_bucket": in_days("shown_us"),
        "sla_age_bucket": in_days("shown_us"),
        "last_modified_by": "last_modified_by",
        "age_in_modified_days": f"date_diff('day', modified_date, {NOW})",
        "modified_date": "modified_date",
        "age_in_days": age,
        "age_days_bucket": bins(age, LONG_BINS, "Above 120"),
        "impact": "impact",
        "sev3_age_days_bucket": bins(age, SHORT_BINS, "Above 15"),
        "status": "status",
        "etl_run_time": "loaded",
    }


def view_sql(resolved: bool, names: list[str] | None = None) -> str:
    """SELECT over ``judged``: all columns of the view, or the case and the named ones."""
    every = columns(resolved)
    chosen = every if names is None else {n: every[n] for n in ["case_id", *names]}
    return "SELECT DISTINCT " + ", ".join(f'{sql} AS "{n}"' for n, sql in chosen.items()) + " FROM judged"
