"""Service-level columns: target, existence of a target, verdict.

Each result is an ordered rule list with three parts: support orders first (resolved cases only),
then conditions that depend on people and on the audit trail, then what category, item and group
say. The first and the last part are settled as soon as their tables are joined, as one column
each, so that rows stay narrow on their way through the later joins.

Input columns come from ``case_frame``: ``grp_`` is the resolver group, ``cti_`` the
category/type/item, ``hub_`` the default hub.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.config.options import Options
from casemetrics.config.people import People
from casemetrics.config.values import V
from casemetrics.functions.clock import DAY_US, business_us
from casemetrics.operators.rules import Rule, first_match

HOUR_US = 3_600_000_000
TARGETS = ["cti_sla_target", "grp_sla_target", "hub_sla_target"]


def _group_in(*groups: str) -> Column:
    return F.col("assigned_to_group").isin(*groups)


def _given(name: str) -> Rule:
    return F.col(name).isNotNull(), F.col(name)


def _recruiting() -> Column:
    return _group_in(*V.RECRUITING_GROUPS) & (F.col("impact") == 2)


def _course() -> Column:
    causes = [F.col(name).isin(V.COURSE_CAUSES) for name in ("root_cause", "root_cause_details")]
    return (
        (F.col("category") == V.COURSE_CATEGORY)
        & (F.col("type") == V.COURSE_TYPE)
        & (F.col("item") == V.COURSE_ITEM)
        & reduce(or_, causes)
    )


def _uk_data() -> Column:
    return _group_in(V.UK_DATA_GROUP) & F.col("impact").isin(2, 3)


def _tao_by_impact() -> list[Rule]:
    tao, impact = _group_in(V.TAO_GROUP), F.col("impact")
    return [(tao & (impact == 3), 1), (tao & (impact == 4), 2)]


def _one_day_site() -> Rule:
    return (F.col("impact") == 3) & ~F.col("grp_location").isin(V.NOT_ONE_DAY_SITES), 1


def effective_target(resolved: bool) -> Column:
    """Target in days that the verdict compares the time to resolve with."""
    rules = [
        (_recruiting(), 1),
        (_course(), V.COURSE_TARGET_DAYS),
        (_uk_data(), 1),
        *_tao_by_impact(),
        _given("hub_sla_target"),
        _given("cti_sla_target"),
        _given("grp_sla_target"),
    ]
    return first_match(rules + ([_one_day_site()] if resolved else []), V.DEFAULT_TARGET_DAYS)


def _plain_target(resolved: bool) -> Column:
    """Target shown where no support order, stage or exemption decides."""
    rules = [
        (_recruiting(), 1),
        (_course(), V.COURSE_TARGET_DAYS),
        *_tao_by_impact(),
        _given("hub_sla_target"),
        _given("cti_sla_target"),
        (F.col("grp_sla_exists") == "N", V.NO_SLA),
        _given("grp_sla_target"),
    ]
    return first_match(rules + ([_one_day_site()] if resolved else []), V.DEFAULT_TARGET_DAYS)


def with_targets(cases: DataFrame, resolved: bool) -> DataFrame:
    """Settle what the three joined targets say; they are dropped afterwards."""
    cti, hub = F.col("cti_sla_target"), F.col("hub_sla_target")
    no_group_sla = F.col("grp_sla_exists") == "N"
    cases = cases.withColumns(
        {
            "is_two_stage": reduce(or_, [F.col(t) == V.TWO_STAGE_SLA for t in TARGETS]),
            "has_no_sla": (cti == V.NO_SLA) | (hub == V.NO_SLA),
            "has_no_target": no_group_sla & cti.isNull() & hub.isNull(),
            "is_uk_data": _uk_data(),
            "effective_target": effective_target(resolved),
            "plain_target": _plain_target(resolved),
            "plain_exists": first_match([((cti > 0) | (hub > 0), "Y"), (no_group_sla, "N")], "Y"),
        }
    )
    return cases.drop(*TARGETS, "grp_sla_exists")


def with_time_verdict(cases: DataFrame) -> DataFrame:
    """``Y`` up to the target, ``N`` beyond it, null without a time."""
    late = F.col("sla_ttr_us") > F.col("effective_target") * F.lit(DAY_US)
    verdict = F.when(late, "N").when(~late, "Y")
    return cases.withColumn("time_verdict", verdict).drop("sla_ttr_us")


def _support_order_conditions() -> dict[str, Column]:
    """Benefit support orders by item and resolution; only resolved cases are asked."""
    order = F.col("mapped_transaction") == V.SUPPORT_ORDER
    item, resolution, taken = F.col("item"), F.col("resolution"), F.col("_order_us")
    plain = order & (item == V.SUPPORT_ORDER_ITEM)
    any_duplicate = V.DUPLICATE_RESOLUTIONS + V.FURTHER_DUPLICATE_RESOLUTIONS
    return {
        "_waiting": order & (item == V.WAITING_ITEM),
        "_not_enrolled": order & (item == V.NOT_ENROLLED_ITEM),
        "_any_duplicate": resolution.isin(any_duplicate),
        "_duplicate": plain & resolution.isin(V.DUPLICATE_RESOLUTIONS),
        "_plain": plain,
        "_no_enrolment": plain & resolution.isin(V.NO_ENROLMENT_RESOLUTIONS),
        "_unexplained": plain & resolution.isNull(),
        "_enrolled": plain & resolution.isin(V.ENROLLED_RESOLUTIONS),
        "_no_target": plain & resolution.isin(V.NO_TARGET_RESOLUTIONS),
        "_enrolled_with_target": plain & resolution.isin(V.ENROLLED_WITH_TARGET),
        "_short": taken <= V.SHORT_ORDER_HOURS * HOUR_US,
        "_long": taken <= V.LONG_ORDER_HOURS * HOUR_US,
    }


def with_support_orders(cases: DataFrame) -> DataFrame:
    """Verdict, target and existence flag of support orders, null for every other case."""
    conditions = _support_order_conditions()
    c = {name: F.col(name) for name in conditions}
    verdict = [
        (c["_waiting"], "-"),
        (c["_not_enrolled"] & c["_long"], "Y"),
        (c["_not_enrolled"] & c["_any_duplicate"], "-"),
        ((c["_no_enrolment"] | c["_unexplained"]) & c["_short"], "Y"),
        (c["_duplicate"], "-"),
        (c["_enrolled"] & c["_long"], "Y"),
    ]
    target = [
        (c["_waiting"], V.NO_SLA),
        (c["_not_enrolled"], V.LONG_ORDER_TARGET),
        (c["_no_enrolment"] | c["_unexplained"], V.SHORT_ORDER_TARGET),
        (c["_plain"] & c["_any_duplicate"], V.NO_SLA),
        (c["_enrolled"], V.LONG_ORDER_TARGET),
    ]
    exists = [
        (c["_waiting"], "N"),
        (c["_not_enrolled"] | c["_no_enrolment"], "Y"),
        (c["_unexplained"] & c["_short"], "Y"),
        (c["_no_target"], "N"),
        (c["_enrolled_with_target"], "Y"),
    ]
    results = {
        "order_verdict": first_match(verdict),
        "order_target": first_match(target),
        "order_exists": first_match(exists),
    }
    cases = cases.withColumn("_order_us", business_us("create_date", "resolved_date"))
    return cases.withColumns(conditions).withColumns(results).drop("_order_us", *conditions)


def with_managed(cases: DataFrame, people: People) -> DataFrame:
    """Extended onboarding requested under the manager without an SLA."""
    manager = people.is_in(F.col("req_level5"), "extended_onboarding_manager")
    managed = _group_in(V.EXTENDED_ONBOARDING) & manager
    return cases.withColumn("is_managed", managed).drop("req_level5")


def with_exemptions(cases: DataFrame, people: People, options: Options) -> DataFrame:
    """``is_exempt`` unites the exemptions that stand next to each other in all three results."""
    extended, onboarding = _group_in(V.EXTENDED_ONBOARDING), _group_in(*V.ONBOARDING_GROUPS)
    own_staff = (extended & F.col("recent_extended")) | (onboarding & F.col("recent_onboarding"))
    any_onboarding = extended | onboarding | _group_in(V.INDIA_ONBOARDING)
    duplicate = any_onboarding & (F.col("closure_code") == V.DUPLICATE_CLOSURE)
    other_item = _group_in(V.ONBOARDING) & ~F.col("item").isin(V.ONBOARDING_ITEMS)
    exempt = [own_staff, duplicate, other_item]
    used = ["recent_extended", "recent_onboarding"]
    if options.covers(V.ATTENDANCE):
        attendance = F.lower("grp_process") == V.ATTENDANCE.lower()
        exempt.append(attendance & people.is_in(F.col("sub_level7"), "attendance_manager"))
        used.append("sub_level7")
    met = reduce(or_, [F.coalesce(c, F.lit(False)) for c in exempt])
    return cases.withColumn("is_exempt", met).drop(*used)


def _not_marked(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == F.lit(V.NEVER).cast("timestamp_ntz"))


def with_stages(cases: DataFrame) -> DataFrame:
    """Conditions that need the case's marks: the two-stage SLA and audit root causes."""
    two_stage = F.col("is_two_stage")
    first, second = F.col("_first_us"), F.col("_second_us")
    first_limit, second_limit = V.FIRST_STAGE_HOURS * HOUR_US, V.SECOND_STAGE_HOURS * HOUR_US
    audited = F.lower("root_cause").contains("audit") | (F.col("audit_root") > 0)
    spans = {
        "_first_us": F.when(two_stage, business_us("create_date", "two_days")),
        "_second_us": F.when(two_stage, business_us("two_days", "five_days")),
    }
    conditions = {
        "is_unmarked": two_stage & _not_marked("five_days") & _not_marked("two_days"),
        "is_kept": two_stage & (first <= first_limit) & (second <= second_limit),
        "is_missed": two_stage & ((first > first_limit) | (second > second_limit)),
        "is_audited": _group_in(*V.AUDITED_GROUPS) & audited,
    }
    return cases.withColumns(spans).withColumns(conditions).drop(*spans)


def _rules(*pairs: tuple[str, object]) -> list[Rule]:
    return [(F.col(name), value) for name, value in pairs]


def sla_target_met(resolved: bool) -> Column:
    """``Y`` or ``N`` by comparing time with target, ``-`` where no SLA applies."""
    rules = _rules(
        ("is_managed", "-"),
        ("is_unmarked", "-"),
        ("is_kept", "Y"),
        ("is_missed", "N"),
        ("is_audited", "-"),
        ("has_no_sla", "-"),
        ("is_exempt", "-"),
        ("has_no_target", "-"),
    )
    by_rules = first_match(rules, F.col("time_verdict"))
    return F.coalesce("order_verdict", by_rules) if resolved else by_rules


def sla_target_value(resolved: bool) -> Column:
    """Target in days; -1 without an SLA, -5 for the two-stage one."""
    rules = _rules(
        ("is_unmarked", V.NO_SLA),
        ("is_two_stage", V.TWO_STAGE_SLA),
        ("is_managed", V.NO_SLA),
        ("is_uk_data", 1),
        ("is_audited", V.NO_SLA),
        ("is_exempt", V.NO_SLA),
    )
    by_rules = first_match(rules, F.col("plain_target"))
    return F.coalesce("order_target", by_rules) if resolved else by_rules


def sla_target_exists(resolved: bool) -> Column:
    """``Y`` when an SLA applies to the case, else ``N``."""
    rules = _rules(
        ("is_unmarked", "N"),
        ("is_two_stage", "Y"),
        ("has_no_sla", "N"),
        ("is_managed", "N"),
        ("is_audited", "N"),
        ("is_exempt", "N"),
    )
    by_rules = first_match(rules, F.col("plain_exists"))
    return F.coalesce("order_exists", by_rules) if resolved else by_rules
