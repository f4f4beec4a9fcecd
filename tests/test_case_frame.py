"""The case frame's way: mapping tables once per combination, waiting columns in a struct."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from casemetrics.operators.sizing import within
from casemetrics.plans import attributes as A
from casemetrics.plans.case_frame import (
    case_frame,
    in_scope,
    people_profiles,
    settled_desks,
    with_cti_slas,
    with_default_hubs,
    with_desks,
    with_people,
    with_requester,
    with_transactions,
)
from casemetrics.plans.views import open_case_metrics
from tests.builders import OPTIONS, PEOPLE, tables

GROUP = {"report_switch": 1, "hrsd": "Y"}
CTI = {"category": "Cat", "type": "Typ", "item": "Itm"}


def some_tables(spark):
    keys = [("Desk", "Cat"), ("Desk", "Cat"), ("Desk", None), ("Shared", "Cat"), ("Shared", None), ("Other", "Cat")]
    keys += [(None, "Cat"), ("desk", "CAT")]
    tickets = [
        {**CTI, "case_id": str(n % 7), "assigned_to_group": g, "category": c, "item": [None, "Itm"][n % 2]}
        for n, (g, c) in enumerate(keys * 2)
    ]
    tickets += [{**CTI, "case_id": None, "assigned_to_group": "Desk", "type": None}]
    groups = [("Desk", "Benefits"), ("Desk", "benefits"), ("Shared", "ALL"), ("Other", "Exits"), (None, "Benefits")]
    return tables(
        spark,
        tickets=tickets,
        groups=[{**GROUP, "resolver_group": g, "dash_process": p} for g, p in groups],
        cti_process=[
            {"category": c, "type": "Typ", "country": k, "global_process": "Benefits"}
            for c, k in (("Cat", "A"), ("Cat", "B"), (None, "C"))
        ],
        cti_slas=[{**CTI, "sla_target": n} for n in (3, 4)] + [{**CTI, "item": None, "sla_target": 9}],
        default_hubs=[{**CTI, "item": "ITM", "resolver_group": "DESK", "default_hub": "H", "sla_target": 2}],
        transactions=[{**CTI, "assigned_to_group": "Desk", "transaction_type": t} for t in ("T", "U")],
    )


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 1}], ids=["broadcast", "salted"])
def test_combinations_settle_what_every_ticket_would(spark, limits):
    options, given = replace(OPTIONS, **limits), some_tables(spark)
    with within(options.budget()):
        plain = in_scope(given.tickets, given, options)
        plain = plain.withColumns({"known_country": A.known_country(), "process": A.process()})
        plain = with_transactions(with_default_hubs(with_cti_slas(plain, given), given), given)
        desks = settled_desks(given.tickets, given, options, ["targets", "orders"])
        found = with_desks(given.tickets, desks, given)
    names = sorted(found.columns)
    assert names == sorted(set(plain.columns) - {"cti_country", "cti_process"})
    rows = [sorted(map(str, df.select(*names).collect())) for df in (plain, found)]
    assert rows[0] == rows[1] and len(rows[0]) > 20


def test_tickets_meet_the_mapping_tables_in_one_join(spark):
    frame = case_frame(some_tables(spark), PEOPLE, OPTIONS, False, ["targets", "orders"])
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_waiting_columns_travel_as_one(spark):
    view = open_case_metrics(some_tables(spark), PEOPLE, OPTIONS)
    lines = view._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(n for n, line in enumerate(lines) if "_rsv_login" in line and "Join" in line)
    below = lines[join + 1]
    assert "Project" in below and "_settled#" in below and "last_modified_by#" not in below


def with_people_of_two_profiles(spark):
    people = [("ann", "USA"), ("ANN", "CHN"), ("Ann", "USA"), ("bob", "JPN")]
    return replace(
        some_tables(spark),
        tickets=some_tables(spark).tickets.withColumn("requester_login", F.when(F.col("case_id") > "2", "Ann")),
        headcount=tables(
            spark, headcount=[{"employee_login": n, "company_country_code": c} for n, c in people]
        ).headcount,
    )


def test_requesters_in_sets_are_the_distinct_rows_of_the_plain_join(spark):
    given = with_people_of_two_profiles(spark)
    profiles = people_profiles(given.headcount, PEOPLE, OPTIONS)
    cases = given.tickets.withColumn("grp_location", F.lit(None).cast("string"))
    plain = with_people(cases, given.tickets, profiles, PEOPLE, OPTIONS, True)
    sets = with_people(cases, given.tickets, profiles, PEOPLE, OPTIONS, True, in_sets=True)
    assert sets.count() == cases.count() < plain.count()
    rows = [set(map(str, df.select(*plain.columns).collect())) for df in (plain, with_requester(sets, PEOPLE))]
    assert rows[0] == rows[1] and any("CHN" in r for r in rows[0]) and any("USA" in r for r in rows[0])


def test_requesters_multiply_rows_of_a_view_after_its_last_join(spark):
    view = open_case_metrics(with_people_of_two_profiles(spark), PEOPLE, OPTIONS)
    lines = view._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(n for n, line in enumerate(lines) if "explode(_requester" in line)
    assert explode < min(n for n, line in enumerate(lines) if "Join " in line)


def test_salts_of_a_view_hash_narrow_columns(spark):
    options = replace(OPTIONS, broadcast_rows=0, hot_rows=1)
    plan = open_case_metrics(with_people_of_two_profiles(spark), PEOPLE, options)._jdf.queryExecution().optimizedPlan().toString()
    salts = [line for line in plan.splitlines() if "pmod(xxhash64(" in line and "_settled" in line]
    assert salts and not any("_settled" in h for line in salts for h in re.findall(r"pmod\(xxhash64\(([^)]*)\)", line))
