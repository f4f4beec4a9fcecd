"""One hit and one near miss per rule of the three SLA results."""

import datetime as dt

import pytest

from casemetrics.config import fixed_values as V
from casemetrics.config.options import Options
from casemetrics.plans import sla
from tests.builders import OPTIONS, PEOPLE, at

TYPES = {
    "name": "string",
    "assigned_to_group": "string",
    "category": "string",
    "type": "string",
    "item": "string",
    "impact": "int",
    "root_cause": "string",
    "root_cause_details": "string",
    "resolution": "string",
    "closure_code": "string",
    "create_date": "timestamp_ntz",
    "resolved_date": "timestamp_ntz",
    "cti_sla_target": "int",
    "grp_sla_target": "int",
    "hub_sla_target": "int",
    "grp_sla_exists": "string",
    "grp_location": "string",
    "grp_process": "string",
    "sla_ttr_us": "bigint",
    "mapped_transaction": "string",
    "req_level5": "string",
    "sub_level7": "string",
    "recent_extended": "boolean",
    "recent_onboarding": "boolean",
    "two_days": "timestamp_ntz",
    "five_days": "timestamp_ntz",
    "audit_root": "int",
}
MONDAY = at("2020-01-06 00:00:00")
DAY = dt.timedelta(days=1)
NEVER = at("2099-01-01 00:00:00")
DAY_US = 86_400_000_000


def judge(spark, rows, resolved, options=OPTIONS):
    base = {"assigned_to_group": "Desk", "create_date": MONDAY, "sla_ttr_us": DAY_US}
    data = [tuple({**base, "name": n, **row}.get(c) for c in TYPES) for n, row in rows.items()]
    cases = spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t in TYPES.items()))
    cases = sla.with_time_verdict(sla.with_targets(cases, resolved))
    cases = sla.with_support_orders(cases) if resolved else cases
    cases = sla.with_stages(
        sla.with_exemptions(sla.with_managed(cases, PEOPLE), PEOPLE, options)
    )
    found = cases.select(
        "name",
        sla.sla_target_met(resolved),
        sla.sla_target_value(resolved),
        sla.sla_target_exists(resolved),
    )
    return {r[0]: tuple(r[1:]) for r in found.collect()}


def staged(first, second, **more):
    """A two-stage case whose marks come ``first`` and ``second`` work days apart."""
    two = MONDAY + first * DAY if first is not None else NEVER
    return {"grp_sla_target": -5, "two_days": two, "five_days": two + second * DAY, **more}


GROUP = "assigned_to_group"
OPEN_CASES = {
    "plain": ({}, ("Y", 2, "Y")),
    "on target": ({"grp_sla_target": 1}, ("Y", 1, "Y")),
    "just late": ({"grp_sla_target": 1, "sla_ttr_us": DAY_US + 1}, ("N", 1, "Y")),
    "no time": ({"sla_ttr_us": None}, (None, 2, "Y")),
    "before start": ({"sla_ttr_us": -1, "grp_sla_target": 0}, ("Y", 0, "Y")),
    "managed": ({GROUP: V.EXTENDED_ONBOARDING, "req_level5": "EOM"}, ("-", -1, "N")),
    "other manager": ({GROUP: V.EXTENDED_ONBOARDING, "req_level5": "OTHER"}, ("Y", 2, "Y")),
    "managed elsewhere": ({"req_level5": "EOM"}, ("Y", 2, "Y")),
    "unmarked": ({"cti_sla_target": -5, "two_days": NEVER, "five_days": NEVER}, ("-", -1, "N")),
    "no trail": ({"hub_sla_target": -5}, ("-", -1, "N")),
    "both kept": (staged(2, 2), ("Y", -5, "Y")),
    "first late": (staged(3, 1), ("N", -5, "Y")),
    "second late": (
        {"grp_sla_target": -5, "two_days": MONDAY, "five_days": MONDAY + 8 * DAY},
        ("N", -5, "Y"),
    ),
    "second missing": (
        {"grp_sla_target": -5, "two_days": MONDAY, "five_days": NEVER},
        ("N", -5, "Y"),
    ),
    "managed and staged": (
        staged(2, 2, **{GROUP: V.EXTENDED_ONBOARDING, "req_level5": "EOM"}),
        ("-", -5, "Y"),
    ),
    "audited by cause": (
        {GROUP: V.AUDITED_GROUPS[0], "root_cause": "An AUDIT note"},
        ("-", -1, "N"),
    ),
    "audited by mark": ({GROUP: V.AUDITED_GROUPS[1], "audit_root": 1}, ("-", -1, "N")),
    "not audited": ({GROUP: V.AUDITED_GROUPS[1], "audit_root": 0}, ("Y", 2, "Y")),
    "audit elsewhere": ({"audit_root": 1}, ("Y", 2, "Y")),
    "hub without sla": ({"hub_sla_target": -1}, ("-", -1, "N")),
    "cti without sla": ({"cti_sla_target": -1, "hub_sla_target": 4}, ("-", 4, "N")),
    "sent by extended staff": (
        {GROUP: V.EXTENDED_ONBOARDING, "recent_extended": True},
        ("-", -1, "N"),
    ),
    "sent by onboarding staff": (
        {GROUP: "Internal Transfers", "recent_onboarding": True},
        ("-", -1, "N"),
    ),
    "staff of the other team": (
        {GROUP: "Internal Transfers", "recent_extended": True},
        ("Y", 2, "Y"),
    ),
    "duplicate": ({GROUP: "erc india onboarding", "closure_code": "Duplicate"}, ("-", -1, "N")),
    "duplicate elsewhere": ({"closure_code": "Duplicate"}, ("Y", 2, "Y")),
    "foreign item": ({GROUP: V.ONBOARDING, "item": "Payslip"}, ("-", -1, "N")),
    "own item": ({GROUP: V.ONBOARDING, "item": "Conversion"}, ("Y", 2, "Y")),
    "item missing": ({GROUP: V.ONBOARDING}, ("Y", 2, "Y")),
    "group without sla": ({"grp_sla_exists": "N"}, ("-", -1, "N")),
    "group without sla, cti with": (
        {"grp_sla_exists": "N", "cti_sla_target": 3},
        ("Y", 3, "Y"),
    ),
    "zero target": ({"grp_sla_exists": "N", "cti_sla_target": 0}, ("N", 0, "N")),
    "recruiting": ({GROUP: "Executive Recruiting", "impact": 2, "hub_sla_target": 9}, ("Y", 1, "Y")),
    "recruiting, other impact": (
        {GROUP: "Executive Recruiting", "impact": 3, "hub_sla_target": 9},
        ("Y", 9, "Y"),
    ),
    "course": (
        {
            "category": V.COURSE_CATEGORY,
            "type": V.COURSE_TYPE,
            "item": V.COURSE_ITEM,
            "root_cause_details": "PRG Languages CZ",
        },
        ("Y", 7, "Y"),
    ),
    "other course": (
        {"category": V.COURSE_CATEGORY, "type": V.COURSE_TYPE, "item": V.COURSE_ITEM},
        ("Y", 2, "Y"),
    ),
    "uk": ({GROUP: V.UK_DATA_GROUP, "impact": 3, "hub_sla_target": 9}, ("Y", 1, "Y")),
    "uk, other impact": ({GROUP: V.UK_DATA_GROUP, "impact": 4, "hub_sla_target": 9}, ("Y", 9, "Y")),
    "tao three": ({GROUP: V.TAO_GROUP, "impact": 3, "hub_sla_target": 9}, ("Y", 1, "Y")),
    "tao four": ({GROUP: V.TAO_GROUP, "impact": 4, "hub_sla_target": 9}, ("Y", 2, "Y")),
    "tao five": ({GROUP: V.TAO_GROUP, "impact": 5, "hub_sla_target": 9}, ("Y", 9, "Y")),
    "hub before cti": ({"hub_sla_target": 3, "cti_sla_target": 4, "grp_sla_target": 5}, ("Y", 3, "Y")),
    "cti before group": ({"cti_sla_target": 4, "grp_sla_target": 5}, ("Y", 4, "Y")),
    "impact three": ({"impact": 3, "grp_location": "SEA", "sla_ttr_us": 2 * DAY_US}, ("Y", 2, "Y")),
}


def test_open_rules(spark):
    found = judge(spark, {n: row for n, (row, _) in OPEN_CASES.items()}, resolved=False)
    assert found == {n: expected for n, (_, expected) in OPEN_CASES.items()}


def order(item, resolution, taken, **more):
    return {
        "mapped_transaction": "Benefit Support Order",
        "item": item,
        "resolution": resolution,
        "resolved_date": MONDAY + dt.timedelta(days=taken),
        **more,
    }


PLAIN, MISSING = V.SUPPORT_ORDER_ITEM, V.NOT_ENROLLED_ITEM
DUPLICATE = V.DUPLICATE_RESOLUTIONS[1]
FURTHER = V.FURTHER_DUPLICATE_RESOLUTIONS[1]
UNENROLLED = "Did not Enroll - Employee on LOA"
# 28 calendar days from a Monday are 20 work days, 56 are 40.
RESOLVED_CASES = {
    "waiting": (order(V.WAITING_ITEM, None, 1), ("-", -1, "N")),
    "waiting, other type": ({"item": V.WAITING_ITEM}, ("Y", 2, "Y")),
    "missing in time": (order(MISSING, "any", 56), ("Y", 40, "Y")),
    "missing late": (order(MISSING, "any", 57), ("Y", 40, "Y")),
    "missing late, slow": (order(MISSING, "any", 57, sla_ttr_us=3 * DAY_US), ("N", 40, "Y")),
    "missing late duplicate": (order(MISSING, FURTHER, 57), ("-", 40, "Y")),
    "unenrolled in time": (order(PLAIN, UNENROLLED, 28, sla_ttr_us=9 * DAY_US), ("Y", 20, "Y")),
    "unenrolled late": (order(PLAIN, UNENROLLED, 29, sla_ttr_us=9 * DAY_US), ("N", 20, "Y")),
    "unexplained in time": (order(PLAIN, None, 28, sla_ttr_us=9 * DAY_US), ("Y", 20, "Y")),
    "unexplained late": (
        order(PLAIN, None, 29, sla_ttr_us=9 * DAY_US, grp_sla_exists="N"),
        ("-", 20, "N"),
    ),
    "duplicate": (order(PLAIN, DUPLICATE, 100), ("-", -1, "N")),
    "further duplicate": (order(PLAIN, FURTHER, 100), ("Y", -1, "Y")),
    "enrolled in time": (order(PLAIN, "Enrolled Dependent", 56, sla_ttr_us=9 * DAY_US), ("Y", 40, "Y")),
    "enrolled late": (
        order(PLAIN, "Enrolled Dependent", 57, sla_ttr_us=9 * DAY_US, grp_sla_exists="N"),
        ("-", 40, "N"),
    ),
    "enrolled with target": (
        order(PLAIN, "Enrolled -Enrolled Dependent", 57, grp_sla_exists="N"),
        ("-", 40, "Y"),
    ),
    "no enrolment beats no target": (
        order(PLAIN, "Release - Employee Terminated", 28, sla_ttr_us=9 * DAY_US),
        ("Y", 20, "Y"),
    ),
    "unknown resolution": (order(PLAIN, "Unknown", 1), ("Y", 2, "Y")),
    "impact three": ({"impact": 3, "grp_location": "SEA", "sla_ttr_us": 2 * DAY_US}, ("N", 1, "Y")),
    "impact three in IND": ({"impact": 3, "grp_location": "IND", "sla_ttr_us": 2 * DAY_US}, ("Y", 2, "Y")),
    "impact three, no site": ({"impact": 3, "sla_ttr_us": 2 * DAY_US}, ("Y", 2, "Y")),
}


def test_resolved_rules(spark):
    found = judge(spark, {n: row for n, (row, _) in RESOLVED_CASES.items()}, resolved=True)
    assert found == {n: expected for n, (_, expected) in RESOLVED_CASES.items()}


@pytest.mark.parametrize("scope,expected", [((V.BENEFITS,), "Y"), ((V.BENEFITS, V.ATTENDANCE), "-")])
def test_attendance_rule_needs_its_process_in_scope(spark, scope, expected):
    rows = {"case": {"grp_process": V.ATTENDANCE, "sub_level7": "ATT"}}
    options = Options(scope=scope, as_of=OPTIONS.as_of)
    assert judge(spark, rows, False, options)["case"][0] == expected
