"""Views that follow their tables, and root-cause tags."""

import re
from dataclasses import replace

import pytest

from casemetrics.plans.root_cause_tags import root_cause_tags
from casemetrics.plans.views import open_case_metrics, resolved_case_metrics
from casemetrics.sources import live_view, publish_changes, publish_table, publish_view, read_tables
from casemetrics.sources.schemas import SCHEMAS
from tests.builders import OPTIONS, PEOPLE, at, frame, tables

DAY = at("2019-01-02 00:00:00").date()
OPEN_CASE = {
    "case_id": "c1", "status": "Assigned", "assigned_to_group": "G1", "create_day": DAY,
    "create_date": at("2019-01-02 10:00:00"), "assigned_to_individual": "ann", "requester_login": "bob",
}
GROUP = {"resolver_group": "G1", "report_switch": 1, "hrsd": "Y", "dash_process": "Benefits"}


def employee(login, supervisor):
    return {
        "employee_login": login, "hr_begin_dt": at("2018-01-01 00:00:00"), "company_country_code": "LU",
        "reports_to_supervisor_employee_name": supervisor, "reports_to_level_2_employee_login": "head",
    }


def place(spark, folder, **rows):
    for role in SCHEMAS:
        frame(spark, role, rows.get(role, [])).write.mode("overwrite").parquet(f"{folder}/{role}")
    return {role: f"{folder}/{role}" for role in SCHEMAS}


def test_a_changed_headcount_row_shows_on_the_next_read(spark, tmp_path):
    places = place(spark, tmp_path, tickets=[OPEN_CASE], groups=[GROUP], headcount=[employee("ann", "Eve")])
    view = live_view("open_cases_now", lambda: open_case_metrics(read_tables(spark, places), PEOPLE, OPTIONS))
    assert [r.hrs_supervisor for r in view.read().collect()] == ["Eve"]
    frame(spark, "headcount", [employee("ann", "Zoe")]).write.mode("overwrite").parquet(places["headcount"])
    assert [r.hrs_supervisor for r in view.read().collect()] == ["Zoe"]
    assert [r.hrs_supervisor for r in spark.table("open_cases_now").collect()] == ["Zoe"]


def test_frames_with_stored_parts_are_no_session_view(spark, tmp_path):
    given = tables(spark, tickets=[OPEN_CASE], groups=[GROUP], headcount=[employee("ann", "Eve")])
    for view in (open_case_metrics, resolved_case_metrics):
        df = view(given, PEOPLE, OPTIONS)
        with pytest.raises(ValueError, match="live_view"):
            publish_view(df, "frozen")
        with pytest.raises(ValueError, match="publish_table"):
            publish_view(df.filter("case_id is not null").select("case_id"), "frozen")
    kept = publish_table(df, str(tmp_path / "kept"))
    assert publish_view(kept, "kept").columns == df.columns


def files(folder):
    return {str(f): f.parent.name for f in folder.rglob("*.parquet")}


def test_only_days_that_differ_are_written(spark, tmp_path):
    path, schema = tmp_path / "a table", "id long, day date, note string, more string"
    first, second, third = (at(f"2019-01-0{d} 00:00:00").date() for d in (2, 3, 4))
    rows = [(1, first, "a", None), (2, second, "b", None), (3, None, "c", "d"), (3, None, "c", "d"), (4, third, "e", None)]

    def publish(rows):
        before = files(path)
        got = publish_changes(spark.createDataFrame(rows, schema), str(path), "day")
        assert sorted(map(tuple, got.select("id", "day", "note", "more").collect()), key=str) == sorted(rows, key=str)
        after = files(path)
        return {after[f] for f in after.keys() - before.keys()}, {before[f] for f in before.keys() - after.keys()}

    null = "day=__HIVE_DEFAULT_PARTITION__"
    publish([])
    assert publish(rows)[0] == {"day=2019-01-02", "day=2019-01-03", "day=2019-01-04", null}
    assert publish(rows[::-1]) == (set(), set())
    rows[1] = (2, second, None, "b")  # the value moves to the next column
    assert publish(rows) == ({"day=2019-01-03"}, {"day=2019-01-03"})
    del rows[2]  # one of two equal rows
    assert publish(rows) == ({null}, {null})
    del rows[0]  # the last row of a day
    assert publish(rows) == (set(), {"day=2019-01-02"})
    rows = [r for r in rows if r[1]] + [(5, at("2019-01-05 00:00:00").date(), "f", "g")]
    assert publish(rows) == ({"day=2019-01-05"}, {null})


def test_resolved_view_rewrites_the_changed_days(spark, tmp_path):
    def resolved(case, day, **more):
        done = {"status": "Resolved", "resolved_date": at(f"{day} 10:00:00"), "resolved_by": "ann"}
        return {**OPEN_CASE, "case_id": case, **done, **more}

    def view(cases):
        return resolved_case_metrics(tables(spark, tickets=cases, groups=[GROUP]), PEOPLE, OPTIONS)

    cases = [resolved("c1", "2019-03-06"), resolved("c2", "2019-03-07"), resolved("c3", "2019-03-05")]
    path = tmp_path / "resolved"
    publish_table(view(cases), str(path), "resolved_date")
    before = files(path)
    assert len(before) == 3
    cases[2] = resolved("c3", "2019-03-05", requester_login="zoe")
    got = publish_changes(view(cases), str(path), "resolved_date")
    after = files(path)
    assert {after[f] for f in after.keys() - before.keys()} == {"resolved_date=2019-03-05"}
    whole = publish_table(view(cases), str(tmp_path / "whole"), "resolved_date")
    assert got.schema == whole.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def mark(case, text, time="2019-01-02 11:00:00", **more):
    return {"case_id": case, "type": 261, "to_string": text, "modified_date": time and at(time), "create_day": DAY, **more}


def test_root_cause_tags(spark):
    done = at("2019-02-01 00:00:00")
    tickets = [{"case_id": c, "resolved_date": done} for c in ("a", "b", "c", "d", "a")]
    tickets += [{"case_id": "open"}, {"case_id": "early", "resolved_date": at("2018-09-30 00:00:00")}]
    audit = [
        mark("a", "first"), mark("a", "last", "2019-01-03 11:00:00"), mark("a", "never", type=184),
        mark("b", "x"), mark("b", "y"), mark("b", None),
        mark("c", "dated"), mark("c", "undated", None),
        mark("d", "old", create_day=at("2018-09-30 00:00:00").date()),
        mark("open", "x"), mark("early", "x"), mark("unknown", "x"), mark(None, "x"),
    ]
    given = tables(spark, tickets=tickets, audit=audit)
    got = root_cause_tags(given, OPTIONS).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "last"), ("b", None), ("c", "undated")]
    assert root_cause_tags(tables(spark), OPTIONS).collect() == []


def test_tags_prune_the_trail_and_shuffle_it_once(spark, tmp_path):
    frame(spark, "audit", [mark("a", "x")]).write.partitionBy("create_day").parquet(str(tmp_path / "trail"))
    given = replace(tables(spark), audit=spark.read.parquet(str(tmp_path / "trail")))
    plan = root_cause_tags(given, OPTIONS)._jdf.queryExecution().executedPlan().toString()
    assert "create_day" in re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert plan.count("Exchange hashpartitioning(case_id") == 2 and "Partial" in plan
