"""Queries C1 to C16: the joins of the case views."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemetrics.config import fixed_values as V
from casemetrics.operators.employees import join_person, latest_employees
from casemetrics.operators.latest import latest_one
from casemetrics.operators.rollup import (
    correspondence_counts,
    groups_of_process,
    last_reopening,
    last_routing,
)
from casemetrics.operators.sizing import Budget, left_join_many, lookup_join, size_of, stored, within
from casemetrics.plans.case_frame import (
    recent_staff,
    with_default_hubs,
    with_cti_slas,
    with_listed_cause,
    with_transactions,
)
from casemetrics.plans.ttr_percentiles import (
    grouping_key,
    reported_groups,
    ttr_percentiles,
)
from workload import oracle as O
from workload.registry import query
from workload.roles import OPTIONS
from workload.views import PERCENTILE_PARTS


@query(
    "c1_join_percentiles",
    """SELECT t.case_id, t.status, round(p.tp90onttr, 9) AS tp90onttr
    FROM tickets AS t LEFT JOIN percentiles AS p ON t.case_id = p.case_id""",
    PERCENTILE_PARTS,
)
def join_percentiles(tables):
    found = ttr_percentiles(tables, OPTIONS).select("case_id", "tp90onttr")
    return tables.tickets.select("case_id", "status").join(found, "case_id", "left")


@query(
    "c2_join_exact_keys",
    """SELECT t.case_id, s.sla_target AS cti_sla_target, p.country AS cti_country, p.global_process
    FROM tickets AS t
    LEFT JOIN cti_slas AS s ON t.category = s.category AND t.type = s.type AND t.item = s.item
    LEFT JOIN cti_process AS p ON t.category = p.category AND t.type = p.type""",
)
def join_exact_keys(tables):
    process = tables.cti_process.select(
        "category", "type", F.col("country").alias("cti_country"), "global_process"
    )
    cases = with_cti_slas(tables.tickets, tables)
    cases = lookup_join(cases, process, ["category", "type"], tables.fits["cti_process"])
    return cases.select("case_id", "cti_sla_target", "cti_country", "global_process")


@query(
    "c3_join_any_case",
    """SELECT case_id, a.root_cause AS listed_root_cause, a.root_cause_group AS listed_root_group,
    b.root_cause AS listed_resolution FROM tickets AS t
    LEFT JOIN root_causes AS a ON lower(t.root_cause) = lower(a.root_cause)
    LEFT JOIN root_causes AS b ON lower(t.resolution) = lower(b.root_cause)""",
)
def join_any_case(tables):
    cases = with_listed_cause(
        tables.tickets, tables, "root_cause", "listed_root_cause", "listed_root_group"
    )
    cases = with_listed_cause(cases, tables, "resolution", "listed_resolution")
    return cases.select("case_id", "listed_root_cause", "listed_root_group", "listed_resolution")


@query(
    "c4_join_filtered_lookup",
    """SELECT case_id, location, days_week, super_region FROM tickets
    LEFT JOIN reported ON assigned_to_group = resolver_group""",
    {"reported": O.REPORTED},
)
def join_filtered_lookup(tables):
    groups = reported_groups(tables.groups).withColumnRenamed("resolver_group", "assigned_to_group")
    cases = lookup_join(tables.tickets, groups, ["assigned_to_group"], tables.fits["groups"])
    return cases.select("case_id", "location", "days_week", "super_region")


LAST_MARK = """SELECT case_id, to_string AS root_cause_tag FROM audit WHERE type = 261
    QUALIFY row_number() OVER (PARTITION BY case_id
        ORDER BY modified_date DESC NULLS FIRST, to_string DESC NULLS FIRST) = 1"""


def last_marks(tables):
    marks = tables.audit.filter(F.col("type") == V.ROOT_CAUSE_MARK)
    last = latest_one(marks, ["case_id"], "modified_date", ["to_string"])
    return last.select("case_id", F.col("to_string").alias("root_cause_tag"))


@query(
    "c5_join_top_row",
    """SELECT t.case_id, root_cause_tag FROM tickets AS t
    LEFT JOIN last_mark AS m ON t.case_id = m.case_id""",
    {"last_mark": LAST_MARK},
)
def join_top_row(tables):
    return tables.tickets.select("case_id").join(last_marks(tables), "case_id", "left")


@query(
    "c6_join_aggregate",
    """SELECT t.case_id, letters AS correspondence_count FROM tickets AS t
    LEFT JOIN letters AS l ON t.case_id = l.case_id""",
    {"letters": O.LETTERS},
)
def join_aggregate(tables):
    counts = correspondence_counts(tables.audit, OPTIONS)
    return tables.tickets.select("case_id").join(counts, "case_id", "left")


BRIDGE = f"""SELECT DISTINCT ticket_case_id, concerning_login FROM concerned
    WHERE create_date >= {O.time("concerned_from")}"""


def bridge_logins(tables):
    """One row per case and login as spelled; the case may have any number of them."""
    login = F.col("concerning_login")
    return (
        tables.concerned.filter(
            (F.col("create_date") >= OPTIONS.timestamp("concerned_from"))
            & login.isNotNull()
            & (F.lower(login) != "none")
        )
        .select(F.col("ticket_case_id").alias("case_id"), "concerning_login")
        .distinct()
    )


@query(
    "c7_join_bridge",
    """SELECT t.case_id, concerning_login FROM tickets AS t LEFT JOIN bridge
    ON case_id = ticket_case_id AND concerning_login IS NOT NULL AND lower(concerning_login) <> 'none'""",
    {"bridge": BRIDGE},
)
def join_bridge(tables):
    cases = tables.tickets.select("case_id")
    return left_join_many(cases, bridge_logins(tables), ["case_id"])


@query(
    "c7_hot_keys",
    """SELECT t.case_id, concerning_login FROM tickets AS t LEFT JOIN bridge
    ON case_id = ticket_case_id AND concerning_login IS NOT NULL AND lower(concerning_login) <> 'none'""",
    {"bridge": BRIDGE},
)
def join_bridge_hot(tables):
    cases = tables.tickets.select("case_id")
    return left_join_many(cases, bridge_logins(tables), ["case_id"], hot_rows=3)


@query(
    "c8_join_roles",
    """SELECT t.case_id, req.country AS req_country, ass.supervisor AS asg_supervisor,
    rsv.l6 AS rsv_level6, sub.l7 AS sub_level7 FROM tickets AS t
    LEFT JOIN employees AS req ON lower(requester_login) = req.login
    LEFT JOIN employees AS ass ON lower(assigned_to_individual) = ass.login AND ass.l2 = 'HRHEAD'
    LEFT JOIN employees AS rsv ON lower(resolved_by) = rsv.login AND rsv.l2 = 'HRHEAD'
    LEFT JOIN employees AS sub ON lower(submitted_by) = sub.login AND sub.l2 = 'HRHEAD'""",
    {"employees": O.EMPLOYEES},
)
def join_roles(tables):
    people = stored(
        latest_employees(tables.headcount).select(
            "login",
            "country",
            F.col("reports_to_supervisor").alias("supervisor"),
            F.col("reports_to_level2_login").alias("level2"),
            F.col("reports_to_level6_login").alias("level6"),
            F.col("reports_to_level7_login").alias("level7"),
        )
    )
    fits = size_of(people)
    staff = F.col("level2") == "HRHEAD"
    with within(Budget()):
        cases = join_person(tables.tickets, people, "requester_login", "req", ["country"], None, fits)
        cases = join_person(
            cases, people, "assigned_to_individual", "asg", ["supervisor"], staff, fits
        )
        cases = join_person(cases, people, "resolved_by", "rsv", ["level6"], staff, fits)
        cases = join_person(cases, people, "submitted_by", "sub", ["level7"], staff, fits)
    return cases.select("case_id", "req_country", "asg_supervisor", "rsv_level6", "sub_level7")


@query(
    "c9_join_four_keys",
    """SELECT case_id, default_hub AS hub_default, def_hub_group AS hub_group,
    sla_target AS hub_sla_target FROM tickets AS t LEFT JOIN default_hubs AS d
    ON lower(t.category) = lower(d.category) AND lower(t.type) = lower(d.type)
    AND lower(t.item) = lower(d.item) AND lower(t.assigned_to_group) = lower(d.resolver_group)""",
)
def join_four_keys(tables):
    cases = with_default_hubs(tables.tickets, tables)
    return cases.select("case_id", "hub_default", "hub_group", "hub_sla_target")


@query(
    "c10_join_mixed_case",
    """SELECT case_id, transaction_type AS mapped_transaction FROM tickets AS t
    LEFT JOIN transactions AS x ON t.assigned_to_group = x.assigned_to_group
    AND lower(t.category) = lower(x.category) AND lower(t.type) = lower(x.type)
    AND lower(t.item) = lower(x.item)""",
)
def join_mixed_case(tables):
    return with_transactions(tables.tickets, tables).select("case_id", "mapped_transaction")


@query(
    "c11_join_last_routing",
    """SELECT t.case_id, routed_from, routed_date FROM tickets AS t LEFT JOIN routings AS r
    ON t.case_id = r.case_id AND t.assigned_to_group = r.routed_to""",
    {"routings": O.ROUTINGS},
)
def join_last_routing(tables):
    routing = last_routing(tables.audit, tables.groups, OPTIONS).select(
        "case_id", F.col("routed_to").alias("assigned_to_group"), "routed_from", "routed_date"
    )
    cases = tables.tickets.select("case_id", "assigned_to_group")
    joined = left_join_many(cases, routing, ["case_id", "assigned_to_group"])
    return joined.drop("assigned_to_group")


@query(
    "c12_join_last_reopening",
    """SELECT t.case_id, reopened_by_system, last_reopened_date FROM tickets AS t
    LEFT JOIN reopenings AS r ON t.case_id = r.case_id""",
    {"reopenings": O.REOPENINGS},
)
def join_last_reopening(tables):
    reopening = last_reopening(tables.audit, tables.groups, OPTIONS)
    return left_join_many(tables.tickets.select("case_id"), reopening, ["case_id"])


@query(
    "c13_left_join_as_inner",
    f"""SELECT a.case_id, to_string, modified_date FROM audit AS a LEFT JOIN resolved AS r
    ON a.case_id = r.case_id WHERE type = 261 AND create_day >= {O.date("concerned_from")}
    AND r.case_id IS NOT NULL""",
    {
        "resolved": f"""SELECT case_id FROM tickets
            WHERE resolved_date >= {O.time("resolved_cases_from")}"""
    },
)
def left_join_as_inner(tables):
    resolved = tables.tickets.filter(
        F.col("resolved_date") >= OPTIONS.timestamp("resolved_cases_from")
    ).select("case_id")
    marks = tables.audit.filter(
        (F.col("type") == V.ROOT_CAUSE_MARK)
        & (F.col("create_day") >= OPTIONS.date("concerned_from"))
    )
    joined = lookup_join(marks, resolved, ["case_id"], how="inner", hot_source=tables.audit)
    return joined.select("case_id", "to_string", "modified_date")


@query(
    "c14_semi_join",
    """SELECT case_id, to_string, create_date FROM audit WHERE to_string IN
    (SELECT resolver_group FROM groups WHERE dash_process = 'Benefits')""",
)
def semi_join(tables):
    benefits = groups_of_process(tables.groups, V.BENEFITS)
    events = tables.audit.select("case_id", "to_string", "create_date")
    targets = benefits.withColumnRenamed("resolver_group", "to_string")
    return lookup_join(events, targets, ["to_string"], tables.fits["groups"], "left_semi")


@query(
    "c15_semi_join_joined_key",
    """SELECT case_id FROM tickets WHERE assigned_to_group || category || type || item IN
    (SELECT grouping FROM transactions)""",
)
def semi_join_joined_key(tables):
    cases = tables.tickets.withColumn("grouping", grouping_key()).select("case_id", "grouping")
    mapped = tables.transactions.select("grouping")
    joined = lookup_join(cases, mapped, ["grouping"], tables.fits["transactions"], "left_semi")
    return joined.select("case_id")


@query(
    "c16_existence_flags",
    """SELECT case_id, coalesce(extended, FALSE) AS recent_extended,
    coalesce(onboarding, FALSE) AS recent_onboarding
    FROM tickets LEFT JOIN recent ON submitted_by = login""",
    {"recent": O.RECENT},
)
def existence_flags(tables):
    recent = stored(recent_staff(tables.tickets, OPTIONS))
    cases = lookup_join(tables.tickets.select("case_id", "submitted_by"), recent, ["submitted_by"])
    flags = ["recent_extended", "recent_onboarding"]
    return cases.select("case_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
