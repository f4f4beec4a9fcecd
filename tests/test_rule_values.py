"""Rule values from a table instead of the fixed ones."""

from dataclasses import replace

import pytest

from casemetrics.config import fixed_values
from casemetrics.config.values import NAMES, RuleValues, V, under_options
from casemetrics.operators import rollup as R
from casemetrics.plans.views import open_case_metrics
from tests.builders import OPTIONS, PEOPLE, at, frame, tables

SCHEMA = "name string, key string, value string"


def with_values(*rows):
    return replace(OPTIONS, rule_values=RuleValues.of(rows))


def case(**more):
    day = at("2019-01-02 00:00:00")
    base = {"case_id": "c1", "status": "Assigned", "assigned_to_group": "New Team", "category": "Any", "type": "t"}
    return {**base, "item": "i", "create_day": day.date(), "create_date": day, **more}


GROUP = {
    "resolver_group": "New Team", "report_switch": 1, "hrsd": "Y", "dash_process": "Benefits", "country": "LU",
    "location": "CRI", "sla_target": 2, "sla_target_exists": "Y",
}
CTI = {"category": "Any", "type": "t", "country": "DE", "global_process": "Benefits"}


def view(spark, options, **rows):
    given = tables(spark, **{"tickets": [case()], "groups": [GROUP], "cti_process": [CTI], **rows})
    return open_case_metrics(given, PEOPLE, options).first()


def test_one_group_list_changes_by_rows_alone(spark):
    assert view(spark, OPTIONS).resolver_country == "LU"
    rows = spark.createDataFrame([("CTI_COUNTRY_GROUPS", None, "new team"), ("CTI_COUNTRY_GROUPS", None, "other")], SCHEMA)
    options = replace(OPTIONS, rule_values=RuleValues.from_table(rows))
    assert view(spark, options).resolver_country == "DE"
    assert view(spark, with_values(("CTI_COUNTRY_GROUPS", None, None))).resolver_country == "LU"


def test_labels_numbers_and_mappings(spark):
    options = with_values(
        ("COSTA_RICA_SITE", None, "MOON"),
        ("CATEGORY_COUNTRIES", "Any", "FR"),
        ("UNMAPPED", None, "?"),
        ("DEFAULT_TARGET_DAYS", None, "9"),
        ("OTHER", None, "Rest"),
    )
    fixed, changed = view(spark, OPTIONS), view(spark, options)
    assert (fixed.transaction_type, changed.transaction_type) == ("Benefits Administration", "Rest")
    assert changed.resolver_country == "FR"
    without = {**GROUP, "sla_target": None}
    assert view(spark, OPTIONS, groups=[without]).sla_taget_value == 2
    assert view(spark, options, groups=[without]).sla_taget_value == 9


def test_event_types_of_the_trail(spark):
    day = at("2019-01-02 00:00:00").date()
    events = [{"case_id": "a", "type": 900, "to_string": "9b", "create_day": day}]
    audit = frame(spark, "audit", events)
    options = with_values(("ROOT_CAUSE_MARK", None, "900"), ("FOUR_A_MARKS", None, "9B".lower()))
    assert R.audit_rollup(audit, OPTIONS).count() == 0
    assert R.audit_rollup(audit, options).first().four_a == 1


def test_values_are_in_force_only_while_a_function_builds():
    @under_options
    def read(options):
        return V.OTHER

    assert read(with_values(("OTHER", None, "x"))) == "x"
    assert read(options=OPTIONS) == V.OTHER == fixed_values.OTHER

    @under_options
    def fail(options):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        fail(with_values(("OTHER", None, "x")))
    assert V.OTHER == fixed_values.OTHER


def test_the_fixed_values_as_a_table_change_nothing(spark):
    rows = []
    for name in NAMES:
        value = getattr(fixed_values, name)
        if isinstance(value, list):
            rows += [(name, None, v) for v in value]
        elif isinstance(value, dict):
            rows += [(name, k, v) for k, v in value.items()]
        else:
            rows.append((name, None, str(value)))
    found = RuleValues.from_table(spark.createDataFrame(rows, SCHEMA)).values
    for name in NAMES:
        value = getattr(fixed_values, name)
        assert (sorted(found[name]) if isinstance(value, list) else found[name]) == (
            sorted(value) if isinstance(value, list) else value
        )


@pytest.mark.parametrize(
    "rows",
    [
        [("NO_SUCH_NAME", None, "x")],
        [("MARKS_FROM", None, "2020-01-01")],
        [("OTHER", None, "x"), ("OTHER", None, "y")],
        [("OTHER", None, None)],
        [("CTI_COUNTRY_GROUPS", None, None), ("CTI_COUNTRY_GROUPS", None, "x")],
        [("CATEGORY_COUNTRIES", None, "x")],
        [("REOPENING", None, "no number")],
    ],
)
def test_unreadable_rows_are_refused(rows):
    with pytest.raises(ValueError):
        RuleValues.of(rows)
