"""Both views end to end on hand-made tables."""

import datetime as dt

import pytest

from casemetrics.plans.views import open_case_metrics, resolved_case_metrics
from tests.builders import OPTIONS, PEOPLE, at, tables

OPEN_COLUMNS = """case_id assigned_to_group superregion resolver_country transaction_type category type
item closure_code correspondence_count requester_login submitted_by assigned_to_individual resolved_by
last_modified_type correspondence_bucket create_date resolved_date_time resolved_date resolved_month
resolved_week ttr tp90onttr sla_target_met sla_taget_value sla_target_exists year_month
root_cause_details total_case_count root_cause_defect delivery_location delivery_group sla_days_bucket
sla_age_bucket fcr reopened routed pending process lob1 lob2 country assigned_date last_modified_by
age_in_modified_days modified_date hrs_supervisor age_in_days age_days_bucket impact
sev3_age_days_bucket status etl_run_time""".split()
RESOLVED_COLUMNS = """case_id assigned_to_group superregion resolver_country transaction_type category
type item closure_code correspondence_count requester_login submitted_by assigned_to_individual
resolved_by resolution correspondence_bucket create_date resolved_date_time resolved_date
resolved_month resolved_week ttr tp90onttr sla_target_met sla_taget_value sla_target_exists year_month
root_cause_details total_case_count root_cause_defect delivery_location delivery_group fcr reopened
routed pending process lob1 lob2 country assigned_date escalated hrs_supervisor 4a 4r 4c 4f
root_cause_group created_from_quicklink quicklink_id defect""".split()

CREATED = "2019-05-06 12:00:00"


def ticket(case, **more):
    base = {
        "case_id": case,
        "assigned_to_group": "Desk",
        "category": "Cat",
        "type": "Typ",
        "item": "Itm",
        "status": "Assigned",
        "create_date": at(CREATED),
        "create_day": at(CREATED).date(),
        "dw_last_updated": at("2019-05-31 00:00:00"),
    }
    return {**base, **more}


def closed(case, days=2, **more):
    end = at(CREATED) + dt.timedelta(days=days)
    return ticket(case, **{"status": "Resolved", "resolved_date": end, **more})


def group(name, **more):
    base = {"resolver_group": name, "report_switch": 1, "hrsd": "Y", "dash_process": "Benefits"}
    return {**base, "location": "SITE", "delivery_group": "Hub", "defect_scope": "Y", **more}


def person(login, **more):
    keys = {f"l{n}": f"reports_to_level_{n}_employee_login" for n in range(2, 10)}
    names = {"country": "company_country_code", "dept": "department_org_level1"}
    names["boss"] = "reports_to_supervisor_employee_name"
    begin = more.pop("begin", "2019-01-01 00:00:00")
    row = {{**keys, **names}[k]: v for k, v in more.items()}
    return {"employee_login": login, "hr_begin_dt": at(begin), **row}


def link(case, login):
    return {"ticket_case_id": case, "concerning_login": login, "create_date": at("2019-05-07 00:00:00")}


def mark(case, text, kind=261, **more):
    base = {"case_id": case, "type": kind, "to_string": text, "created_by": "u", "description": "x"}
    when = at("2019-05-07 00:00:00")
    base |= {"create_day": when.date(), "create_date": when, "modified_date": when}
    return {**base, **more}


MANAGERS = [
    person("req", country="DEU", l2="fin"),
    person("con1", country="FRA", l2="shop", dept="Tech"),
    person("con2", country="ITA", l5="svc"),
    person("old", country="AAA", begin="2018-01-01 00:00:00"),
    person("old", country="BBB", l2="fin", begin="2019-02-01 00:00:00"),
    person("phl", country="PHL", l2="head", l6="crm", boss="Boss"),
    person("ind", country="IND", l2="head", l6="inm2"),
    person("ind1", country="IND", l2="head", l6="inm"),
    person("sea", country="USA", l2="head", l5="sea"),
    person("out", country="PHL", l2="other", l6="crm"),
]
GROUPS = [
    group("Desk", country="C1"),
    group("Elsewhere"),
    group("Manila", delivery_group="Manila Hubs", location="MNL"),
    group("Shared", location="IND/CRI", defect_scope="N"),
    group("Ops", dash_process="ALL", location="CRI", super_region="EMEA"),
    group("Low", dash_process="all"),
    group("Pay", dash_process="Payroll"),
    group("Off", report_switch=0),
    group("APAC LOA", country="C2"),
    group("ERC Extended Onboarding"),
    group("Launch", defect_launch=at("2019-05-08 12:00:00")),
]
MAPPINGS = {
    "groups": GROUPS,
    "headcount": MANAGERS,
    "cti_process": [
        {"category": "Cat", "type": "Typ", "country": "P1", "global_process": "BENEFITS"},
        {"category": "Other", "type": "Typ", "global_process": "Payroll"},
    ],
    "root_causes": [
        {"root_cause": "Late Input", "root_cause_group": "Customer"},
        {"root_cause": "No Defect", "root_cause_group": "No Defect"},
        {"root_cause": "Bad form", "root_cause_group": "HRS Defect"},
    ],
    "default_hubs": [
        {
            "category": "CAT",
            "type": "typ",
            "item": "hub",
            "resolver_group": "SHARED",
            "default_hub": "H1",
            "def_hub_group": "HG",
        }
    ],
    "transactions": [
        {
            "assigned_to_group": "Desk",
            "category": "cat",
            "type": "TYP",
            "item": "itm",
            "grouping": "DeskCatTypItm",
            "transaction_type": "Claims",
        }
    ],
}


def rows(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.case_id, []).append(r.asDict())
    return found


@pytest.fixture(scope="module")
def opened(spark):
    cases = [
        ticket("plain", requester_login="REQ"),
        ticket("nobody"),
        ticket("two", requester_login="req"),
        ticket("old", requester_login="old", assigned_to_group="Elsewhere"),
        ticket("null status", status=None),
        ticket("early", create_day=at("2018-09-30 00:00:00").date()),
        ticket("test", root_cause="OAA/WORKFLOW TICKET"),
        ticket("out", assigned_to_group="Pay"),
        ticket("off", assigned_to_group="Off"),
        ticket("ops", assigned_to_group="Ops"),
        ticket("ops out", assigned_to_group="Ops", category="Other"),
        ticket("low", assigned_to_group="Low"),
        ticket("eob", assigned_to_group="Ops", item="Extended Onboarding"),
        ticket("cti", assigned_to_group="APAC LOA"),
        ticket("bel", category="Human Resources - Belgium"),
        ticket("m1", assigned_to_group="Manila", assigned_to_individual="PHL"),
        ticket("m2", assigned_to_group="Manila", assigned_to_individual="out"),
        ticket("s1", assigned_to_group="Shared", resolved_by="phl"),
        ticket("s2", assigned_to_group="Shared", assigned_to_individual="ind"),
        ticket("s3", assigned_to_group="Shared", assigned_to_individual="flx-HRDMIVS"),
        ticket("s4", assigned_to_group="Shared", assigned_to_individual="sam"),
        ticket("s5", assigned_to_group="Shared", assigned_to_individual="sea"),
        ticket("s6", assigned_to_group="Shared", item="Hub"),
        ticket("s7", assigned_to_group="Shared"),
        ticket("s8", assigned_to_group="Shared", resolved_by="ind1"),
        ticket("done", status="Closed", resolved_date=at("2019-05-07 00:00:00")),
    ]
    bridge = [link("two", "con1"), link("two", "CON2"), link("two", "None"), link("two", None)]
    bridge += [link("plain", "unknown")]
    audit = [mark("plain", "7"), mark("plain", None, 184), *[mark("plain", None, 179)] * 5]
    given = tables(spark, tickets=cases, concerned=bridge, audit=audit, **MAPPINGS)
    df = open_case_metrics(given, PEOPLE, OPTIONS)
    return df, rows(df)


def test_open_columns_and_scope(opened):
    df, found = opened
    assert df.columns == OPEN_COLUMNS
    left_out = {"null status", "early", "test", "out", "off", "ops out", "done"}
    assert not left_out & set(found) and {"ops", "low", "eob", "plain"} <= set(found)


def test_open_values(opened):
    _, found = opened
    (plain,) = found["plain"]
    assert plain["case_id"] == "plain" and plain["resolver_country"] == "C1"
    assert (plain["total_case_count"], plain["reopened"], plain["fcr"]) == (7, "Y", "N")
    assert (plain["correspondence_count"], plain["correspondence_bucket"]) == (5, "4 to 10")
    assert plain["transaction_type"] == "Claims" and plain["create_date"] == CREATED
    assert (plain["lob1"], plain["lob2"]) == ("CORP", "FINANCE")
    assert plain["etl_run_time"] == at("2019-05-31 00:00:00") and plain["tp90onttr"] is None
    assert plain["ttr"] == plain["sla_days_bucket"] == 18.5
    assert (plain["age_in_days"], plain["age_days_bucket"]) == (26, "26 to 30")
    assert plain["sev3_age_days_bucket"] == "Above 15" and plain["last_modified_type"] == ""
    (nobody,) = found["nobody"]
    assert (nobody["lob1"], nobody["lob2"], nobody["fcr"]) == ("OPS", "OPS", "Y")
    assert nobody["total_case_count"] == 1 and nobody["correspondence_bucket"] is None


def test_open_people(opened):
    _, found = opened
    assert sorted(r["lob2"] for r in found["two"]) == ["CS", "WW_CONSUMER"]
    assert sorted(r["lob1"] for r in found["two"]) == ["CORP", "CS"]
    (old,) = found["old"]
    assert old["resolver_country"] == "BBB" and old["lob2"] == "FINANCE"
    assert found["cti"][0]["resolver_country"] == "P1"


def test_open_place_and_process(opened):
    _, found = opened
    place = {c: (r[0]["delivery_location"], r[0]["delivery_group"]) for c, r in found.items()}
    assert place["m1"] == ("MNL", "Manila Hubs") and found["m1"][0]["hrs_supervisor"] == "Boss"
    assert place["m2"] == ("MNL", "Manila Hubs") and found["m2"][0]["hrs_supervisor"] is None
    assert place["s1"] == ("CRI", "Costa Rica Hub")
    assert place["s2"] == ("IND", "Other")
    assert place["s3"] == ("IND", "India Hubs")
    assert place["s4"] == ("SEA", "Other") and place["s5"] == ("SEA", "Other")
    assert place["s6"] == ("H1", "HG") and place["s7"] == ("SEA", "Other")
    assert place["s8"] == ("IND", "India Hubs")
    assert found["ops"][0]["process"] == "BENEFITS" and found["low"][0]["process"] == "all"
    assert found["eob"][0]["process"] == "EOB" and found["plain"][0]["process"] == "Benefits"
    assert found["ops"][0]["transaction_type"] == "Benefits Administration"


@pytest.fixture(scope="module")
def resolved(spark):
    no_defect = {"root_cause": "No Defect"}
    cases = [
        closed("a"),
        closed("b", days=4),
        closed("c", days=1, assigned_to_group="Elsewhere"),
        closed("listed", resolution="late input", root_cause="No Defect"),
        closed("blank"),
        closed("x", root_cause="x"),
        closed("unlisted", root_cause="Strange"),
        closed("case", root_cause="LATE input"),
        closed("form", root_cause="Bad form"),
        closed("info", root_cause_details="Pending HR", **no_defect),
        closed("hr", root_cause_details="HR", **no_defect),
        closed("process", root_cause_details="the LDW", **no_defect),
        closed("routed", **no_defect),
        closed("routed in time", **no_defect),
        closed("sys", **no_defect),
        closed("both", **no_defect),
        closed("pending", **no_defect),
        closed("unscoped", root_cause="Bad form", assigned_to_group="Shared"),
        closed("launched", root_cause="Bad form", assigned_to_group="Launch"),
        closed("unlaunched", days=1, root_cause="Bad form", assigned_to_group="Launch"),
        closed("marks"),
        closed("early", resolved_date=at("2018-09-30 00:00:00")),
        ticket("open"),
    ]
    late, soon = at("2019-05-20 00:00:00"), at("2019-05-07 00:00:00")
    audit = [
        mark("routed", "Desk", 1, from_string="S", create_date=late),
        mark("routed in time", "Desk", 1, from_string="S", create_date=soon),
        mark("sys", None, 184, assigned_to="Exit", created_by="flx-term", create_date=late),
        mark("both", None, 184, assigned_to="Exit", created_by="flx-term", create_date=late),
        mark("both", None, 184, assigned_to="Exit", create_date=late),
        mark("pending", None, 10, description="Pending Reason"),
        mark("marks", "4A"),
        mark("marks", "4c"),
        mark("marks", "https://quicklink/Zed", 370, description="Assigned Group", from_string="a"),
        mark("marks", "1", 20, description="Assigned Group", from_string="2"),
    ]
    groups = [*GROUPS, group("Exit", dash_process="Exits")]
    given = tables(spark, tickets=cases, audit=audit, **{**MAPPINGS, "groups": groups})
    df = resolved_case_metrics(given, PEOPLE, OPTIONS)
    return df, rows(df)


def test_resolved_columns_and_disjoint(resolved, opened):
    df, found = resolved
    assert df.columns == RESOLVED_COLUMNS
    assert not {"open", "early"} & set(found) and not set(found) & set(opened[1])


def test_resolved_percentile(resolved):
    _, found = resolved
    assert found["a"][0]["ttr"] == 2.0
    # Desk in May: one case of 4 days, the others of 2.
    assert found["a"][0]["tp90onttr"] == found["b"][0]["tp90onttr"] == pytest.approx(2.0)
    assert found["c"][0]["tp90onttr"] is None
    assert found["a"][0]["year_month"] == at("2019-05-01 00:00:00")


def test_resolved_causes(resolved):
    _, found = resolved
    cause = {c: sorted(r["root_cause_group"] for r in rs) for c, rs in found.items()}
    assert cause["listed"] == ["Late Input"] and cause["blank"] == cause["x"] == ["Blank"]
    assert cause["unlisted"] == ["Other root cause"] and cause["case"] == ["Customer"]
    assert cause["form"] == ["Lifecycle Defect"] and cause["info"] == ["Missing Info"]
    assert cause["hr"] == ["Lifecycle Defect"] and cause["process"] == ["Process Dependency"]
    assert cause["routed"] == ["Routed_After_SLA_Lapse"]
    assert cause["routed in time"] == ["Lifecycle Defect"]
    assert cause["sys"] == ["Reopened_Sys_After_SLA_Lapse"]
    assert cause["both"] == ["Reopened_Pers_After_SLA_Lapse", "Reopened_Sys_After_SLA_Lapse"]
    assert cause["pending"] == ["Missing Info"]
    defect = {c: rs[0]["root_cause_defect"] for c, rs in found.items()}
    assert defect["case"] == "Late Input" and defect["unlisted"] == "Other root cause"
    assert defect["unscoped"] == "Not Defect Scope" and defect["unlaunched"] == "Not Defect Scope"
    assert defect["launched"] == "Bad form" and defect["blank"] == "Blank"


def test_resolved_marks(resolved):
    _, found = resolved
    (marks,) = found["marks"]
    assert [marks[k] for k in ("4a", "4r", "4c", "4f", "escalated")] == ["Y", "N", "Y", "N", "Y"]
    assert (marks["created_from_quicklink"], marks["quicklink_id"]) == ("Y", "Zed")
    assert (marks["routed"], marks["defect"]) == ("Y", "Y")
    assert found["info"][0]["defect"] == "N" and found["info"][0]["quicklink_id"] is None


@pytest.mark.parametrize("view", ["opened", "resolved"])
def test_plans(view, request):
    df, _ = request.getfixturevalue(view)
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    top = plan.split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]
    assert "Exchange hashpartitioning" not in top.split("Subquery")[0], "DISTINCT must not shuffle"
    optimized = execution.optimizedPlan().toString()
    assert "Join Inner" in optimized, "the group test must make the join an inner one"
