"""Queries J1 to J13: the rule chains, each over the joins it needs.

They run with a wider scope than the views, so that the rules of the transfers and the attendance
process take part as well.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from casemetrics.config import fixed_values
from casemetrics.config.values import RuleValues
from casemetrics.plans import attributes as A
from casemetrics.plans import sla
from casemetrics.plans.case_frame import case_frame
from workload import oracle as O
from workload.registry import query
from workload.roles import PEOPLE, WIDE_OPTIONS, FrameRoles

SLA_PARTS = ["times", "targets", "orders", "people", "recent", "history"]


def register(name, resolved, parts, column, build=None, sql=None):
    """The case and one column, distinct, over the frame with the given parts."""
    text = sql or O.view_sql(resolved, [column])

    @query(name, text, O.frame(resolved, WIDE_OPTIONS.scope), FrameRoles)
    def run(tables):
        frame = case_frame(tables, PEOPLE, WIDE_OPTIONS, resolved, parts)
        if "routing" in parts:
            frame = frame.withColumn("sla_taget_value", sla.sla_target_value(resolved))
        found = build() if build else F.col(column)
        return frame.select("case_id", found.alias(column)).distinct()


ORDER_SQL = """SELECT DISTINCT case_id, CASE WHEN waiting THEN '-'
    WHEN missing_employee AND long_order THEN 'Y' WHEN missing_employee AND twice_or_more THEN '-'
    WHEN plain_order AND short_order AND (without_enrolment OR resolution IS NULL) THEN 'Y'
    WHEN plain_order AND twice THEN '-' WHEN plain_order AND enrolled AND long_order THEN 'Y' END
    AS order_verdict FROM flagged"""
EFFECTIVE_SQL = "SELECT DISTINCT case_id, effective AS effective_target FROM judged"

PEOPLE_PARTS = ["people", "concerned"]
PLACE_PARTS = ["targets", "people"]

register("j1_resolver_country", True, PEOPLE_PARTS, "resolver_country", lambda: A.resolver_country())
register("j2_transaction_type", False, ["orders"], "transaction_type")
for _resolved, _suffix in ((False, ""), (True, "_resolved")):
    register(
        f"j3_sla_target_met{_suffix}",
        _resolved,
        SLA_PARTS,
        "sla_target_met",
        lambda resolved=_resolved: sla.sla_target_met(resolved),
    )
    register(
        f"j4_sla_target_value{_suffix}",
        _resolved,
        SLA_PARTS,
        "sla_taget_value",
        lambda resolved=_resolved: sla.sla_target_value(resolved),
    )
    register(
        f"j5_sla_target_exists{_suffix}",
        _resolved,
        SLA_PARTS,
        "sla_target_exists",
        lambda resolved=_resolved: sla.sla_target_exists(resolved),
    )
register("j3b_support_order_verdict", True, ["orders"], "order_verdict", sql=ORDER_SQL)
register("j6_effective_target", True, ["targets"], "effective_target", sql=EFFECTIVE_SQL)
register("j7_root_cause_defect", True, ["causes"], "root_cause_defect")
register("j8_delivery_location", True, PLACE_PARTS, "delivery_location")
register("j9_delivery_group", True, PLACE_PARTS, "delivery_group")
register("j10_process", True, [], "process")
register("j11_lob1", True, PEOPLE_PARTS, "lob1", lambda: A.line_of_business("lob1"))
register("j12_lob2", True, PEOPLE_PARTS, "lob2", lambda: A.line_of_business("lob2"))
register(
    "j13_root_cause_group",
    True,
    [*SLA_PARTS, "causes", "routing"],
    "root_cause_group", lambda: A.root_cause_group(),
)

# The list of groups that follow the country of their category comes from rows of a table here.
FIXED_GROUPS = O.listing(fixed_values.CTI_COUNTRY_GROUPS)
GROUPS_OF_TABLE = "(SELECT lower(resolver_group) FROM groups WHERE days_week = 6)"


def with_groups_of_table(text):
    return text.replace(FIXED_GROUPS, GROUPS_OF_TABLE)


@query(
    "j1_rules_from_table",
    with_groups_of_table(O.view_sql(True, ["resolver_country"])),
    {name: with_groups_of_table(text) for name, text in O.frame(True, WIDE_OPTIONS.scope).items()},
)
def country_by_rules_of_a_table(tables):
    rows = tables.groups.filter("days_week = 6").select(
        F.lit("CTI_COUNTRY_GROUPS").alias("name"),
        F.lit(None).cast("string").alias("key"),
        F.lower("resolver_group").alias("value"),
    )
    options = replace(WIDE_OPTIONS, rule_values=RuleValues.from_table(rows))
    frame = case_frame(tables, PEOPLE, options, True, PEOPLE_PARTS)
    return frame.select("case_id", A.resolver_country().alias("resolver_country")).distinct()
