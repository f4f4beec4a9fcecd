import random
import re
from dataclasses import replace

import pytest

from casemetrics.config import fixed_values as V
from casemetrics.operators import rollup as R
from casemetrics.plans.views import open_case_metrics, resolved_case_metrics
from tests.builders import OPTIONS, PEOPLE, at, frame, tables

DAY = at("2019-01-02 00:00:00").date()


def event(case, kind, **more):
    base = {"case_id": case, "type": kind, "create_day": DAY, "description": "x", "created_by": "u1"}
    return {**base, "create_date": at("2019-01-02 10:00:00"), **more}


def mark(case, text, **more):
    given = {"to_string": text, "modified_date": at("2019-01-02 11:00:00"), **more}
    return event(case, 261, **given)


def by_case(df):
    return {r.case_id: r.asDict() for r in df.collect()}


def test_rollup_counts_and_marks(spark):
    events = [
        mark("a", "2 Days"),
        mark("a", "2day", modified_date=None),
        mark("a", "5days"),
        mark("a", "12"),
        mark("a", "7"),
        mark("a", "999", created_by="AR_ESCALATOR"),
        mark("a", "888", created_by=None),
        mark("a", "1000"),
        mark("a", "4F"),
        mark("a", "4a"),
        mark("a", "Audit done"),
        event("a", 184),
        event("b", 10, description="Assigned Group", from_string="x"),
        event("b", 10, description="Assigned Group"),
        event("b", 10, description="Pending Reason"),
        event("c", 370, to_string="https://a"),
        event("d", 370, to_string="https://a", description="Pending Reason"),
        event("d", 370, to_string="https://b", description="Pending Reason"),
        event("d", 20, from_string="3", to_string="2", description="Pending Reason"),
        event("d", 20, from_string="2", to_string="3", description="Pending Reason"),
        event("d", 20, from_string="3", to_string="2"),
        mark("e", "3", create_day=at("2018-01-01 00:00:00").date()),
    ]
    found = by_case(R.audit_rollup(frame(spark, "audit", events), OPTIONS))
    a, b, d = found["a"], found["b"], found["d"]
    assert set(found) == {"a", "b", "d"}
    assert (a["two_days"], a["five_days"]) == (at("2019-01-02 11:00:00"),) * 2
    assert a["case_count"] == 12 and a["reopened"] == 1 and a["audit_root"] == 1
    assert a["four_f"] == 1 and a["four_a"] == 1 and a["four_r"] == 0
    assert (b["routed"], b["pending"]) == (1, 1) and b["case_count"] is None
    assert b["two_days"] == at(V.NEVER)
    assert (d["created_from_quicklink"], d["quicklink_text"], d["escalated"]) == (2, "https://b", 1)


def test_history_equals_its_parts(spark):
    events = [mark("a", "3"), event("b", 179), event("b", 179), event("c", 1)]
    history = by_case(R.case_history(frame(spark, "audit", events), OPTIONS))
    assert set(history) == {"a", "b"}
    assert history["a"]["correspondence_count"] is None and history["a"]["case_count"] == 3
    assert history["b"]["correspondence_count"] == 2 and history["b"]["routed"] is None


GROUPS = [
    {"resolver_group": "G1", "dash_process": "Benefits"},
    {"resolver_group": "G2", "dash_process": "Benefits"},
    {"resolver_group": "X", "dash_process": "Exits"},
    {"resolver_group": "L", "dash_process": "benefits"},
]


def routing(case, to, time, source="S", **more):
    return event(case, 1, to_string=to, from_string=source, create_date=at(time), **more)


def test_last_routing(spark):
    early, late = "2019-01-02 10:00:00", "2019-01-03 10:00:00"
    events = [
        routing("a", "G1", early),
        routing("a", "G2", late),
        routing("a", "G1", late),
        routing("b", "G1", early),
        routing("b", "X", late),
        routing("b", "L", late),
        routing("c", "G1", early, source=None),
        routing("c", "G1", early, source="DM-Automation-Queue"),
        routing("d", "G1", "2017-12-31 10:00:00"),
    ]
    audit, groups = frame(spark, "audit", events), frame(spark, "groups", GROUPS)
    last = R.last_routing(audit, groups, OPTIONS).select("case_id", "routed_to").collect()
    assert sorted(map(tuple, last)) == [("a", "G1"), ("a", "G2"), ("b", "G1")]
    per_case = {c: r for c, r in by_case(R.resolved_history(audit, groups, OPTIONS)).items() if r["last_routed_to"]}
    assert sorted(per_case["a"]["last_routed_to"]) == ["G1", "G2"]
    assert per_case["a"]["last_routed_date"] == at(late) and set(per_case) == {"a", "b"}


def reopening(case, by, time, group="X"):
    return event(case, 184, created_by=by, assigned_to=group, create_date=at(time))


def test_last_reopening(spark):
    early, late = "2019-01-02 10:00:00", "2019-01-03 10:00:00"
    events = [
        reopening("a", "flx-term", late),
        reopening("a", "u1", early),
        reopening("b", "flx-term", late),
        reopening("b", None, late),
        reopening("c", "u1", late, "G1"),
    ]
    audit, groups = frame(spark, "audit", events), frame(spark, "groups", GROUPS)
    last = R.last_reopening(audit, groups, OPTIONS)
    flags = sorted((r.case_id, r.reopened_by_system) for r in last.collect())
    assert flags == [("a", "Y"), ("b", "N"), ("b", "Y")]
    history = by_case(R.resolved_history(audit, groups, OPTIONS))
    kept = {c: sorted(e.by_system for e in r["last_reopenings"]) for c, r in history.items()}
    assert kept == {"a": ["Y"], "b": ["N", "Y"], "c": []}


def test_trail_is_pruned_by_day(spark, tmp_path):
    frame(spark, "audit", [mark("a", "3")]).write.partitionBy("create_day").parquet(str(tmp_path / "trail"))
    audit, groups = spark.read.parquet(str(tmp_path / "trail")), frame(spark, "groups", GROUPS)
    options = replace(OPTIONS, created_on_day=True)
    for frames, scans in [
        (R.case_history(audit, options), 1),
        (R.resolved_history(audit, groups, options, True), 1),
        (R.last_events(audit, groups, options, True), 1),
        (R.audit_rollup(audit, options), 1),
        (R.quicklink_texts(audit, options), 1),
    ]:
        plan = frames._jdf.queryExecution().executedPlan().toString()
        filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
        assert len(filters) == scans and all("create_day" in f for f in filters), plan


def test_last_events_are_both_kinds(spark):
    early, late = "2019-01-02 10:00:00", "2019-01-03 10:00:00"
    events = [
        routing("a", "G1", early),
        routing("a", "G2", late),
        routing("a", "X", "2019-01-04 10:00:00"),
        reopening("a", "u1", early),
        reopening("a", "flx-term", early),
        reopening("b", "u1", late, "G1"),
    ]
    audit, groups = frame(spark, "audit", events), frame(spark, "groups", GROUPS)
    found = R.last_events(audit, groups, OPTIONS).collect()
    assert sorted((r.case_id, r.event, r.detail) for r in found) == [
        ("a", "reopening", "N"),
        ("a", "reopening", "Y"),
        ("a", "routing", "G2"),
    ]


def random_trail(seed, n=600):
    pick = random.Random(seed)
    times = ["2019-01-02 10:00:00", "2019-01-02 11:00:00", "2019-01-03 10:00:00", "2017-01-01 00:00:00"]
    texts = ["G1", "G2", "X", "2 days", "4a", "7", "audit", "https://a", "https://b", "", None]
    return [
        event(
            pick.choice("abcdefgh") + str(pick.randrange(3)),
            pick.choice([1, 1, 20, 179, 184, 261, 370, 370]),
            description=pick.choice(["x", "Assigned Group", "Pending Reason"]),
            created_by=pick.choice(["u1", "flx-term", "AR_ESCALATOR", None]),
            assigned_to=pick.choice(["X", "G1", None]),
            from_string=pick.choice(["S", "3", "DM-Automation-Queue", None]),
            to_string=pick.choice(texts),
            create_date=at(pick.choice(times)),
            modified_date=at(pick.choice(times[:3])),
            create_day=pick.choice([DAY, DAY, at("2018-01-01 00:00:00").date()]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_one_pass_equals_separate_passes(spark, seed):
    """The merged measures against each reduction on its own, event by event in plain Python."""
    events = random_trail(seed)
    audit, groups = frame(spark, "audit", events), frame(spark, "groups", GROUPS)
    got = by_case(R.resolved_history(audit, groups, OPTIONS))
    plain = by_case(R.case_history(audit, OPTIONS))
    texts = by_case(R.quicklink_texts(audit, OPTIONS))
    rollup = by_case(R.audit_rollup(audit, OPTIONS))
    since = at(OPTIONS.dates["routing_from"])
    for case in {e["case_id"] for e in events}:
        own = [e for e in events if e["case_id"] == case and e["create_date"] >= since]
        routed = [
            e for e in own
            if e["type"] == 1 and e["from_string"] not in (None, "DM-Automation-Queue") and e["to_string"] in ("G1", "G2")
        ]
        last = max((e["create_date"] for e in routed), default=None)
        row = got.get(case, {})
        assert row.get("last_routed_date") == last
        targets = {e["to_string"] for e in routed if e["create_date"] == last}
        assert sorted(row.get("last_routed_to") or []) == sorted(targets)
        again = [e for e in own if e["type"] == 184 and e["assigned_to"] == "X"]
        last = max((e["create_date"] for e in again), default=None)
        flags = {"Y" if e["created_by"] == "flx-term" else "N" for e in again if e["create_date"] == last}
        assert sorted(x.by_system for x in row.get("last_reopenings") or []) == sorted(flags)
        text = texts.get(case, {}).get("quicklink_text")
        assert row.get("quicklink_text") == text == rollup.get(case, {}).get("quicklink_text")
        for name, value in plain.get(case, {}).items():
            assert row[name] == value
            if name in rollup.get(case, {}):
                assert rollup[case][name] == value


def scans(df, folder):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count(f"{folder}]")


def test_the_trail_is_read_once(spark, tmp_path):
    folder = tmp_path / "trail"
    frame(spark, "audit", random_trail(1, 50)).write.parquet(str(folder))
    given = tables(spark, groups=GROUPS)
    audit = spark.read.parquet(str(folder))
    given = replace(given, audit=audit)
    for df in (
        R.audit_rollup(audit, OPTIONS),
        R.last_events(audit, given.groups, OPTIONS),
        R.last_routing(audit, given.groups, OPTIONS),
        R.last_reopening(audit, given.groups, OPTIONS),
        R.resolved_history(audit, given.groups, OPTIONS),
        open_case_metrics(given, PEOPLE, OPTIONS),
        resolved_case_metrics(given, PEOPLE, OPTIONS),
    ):
        assert scans(df, folder) == 1


def test_the_rollup_sorts_no_events(spark):
    """Text maxima are taken of a case's reduced rows; events are only hashed."""
    audit = frame(spark, "audit", random_trail(1, 50))
    plan = R.audit_rollup(audit, OPTIONS)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning(case_id") :]
    assert "HashAggregate" in below and "Sort" not in below


def test_rollup_is_hash_aggregated_without_python(spark):
    audit = frame(spark, "audit", [mark("a", "3")])
    plan = R.case_history(audit, OPTIONS)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning(case_id") == 1
