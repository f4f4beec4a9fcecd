"""Place, process, transaction and line of business of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.config.options import Options
from casemetrics.config.people import People
from casemetrics.config.values import V
from casemetrics.functions.clock import DAY_US, business_us
from casemetrics.functions.text import contains_any, is_blank
from casemetrics.operators.rules import first_match


def known_country() -> Column:
    """Country by group, category and type alone; null leaves it to the people."""
    listed = F.lower("assigned_to_group").isin(V.CTI_COUNTRY_GROUPS)
    return first_match(
        [
            (listed & F.col("cti_country").isNotNull(), F.col("cti_country")),
            *[(F.col("category") == name, code) for name, code in V.CATEGORY_COUNTRIES.items()],
        ],
        F.col("grp_country"),
    )


def resolver_country() -> Column:
    return F.coalesce("known_country", "con_country", "req_country", F.lit(V.UNMAPPED))


def transaction_type(resolved: bool) -> Column:
    mapped = F.coalesce("mapped_transaction", F.lit(V.OTHER))
    if resolved:
        return mapped
    at_costa_rica = F.col("grp_location") == V.COSTA_RICA_SITE
    return first_match([(at_costa_rica, V.COSTA_RICA_TRANSACTION)], mapped)


def root_cause_defect() -> Column:
    out_of_scope = F.col("grp_defect_scope").isNull() | (F.col("grp_defect_scope") != "Y")
    before_launch = F.col("resolved_date") < F.col("grp_defect_launch")
    return first_match(
        [
            (out_of_scope | before_launch, V.NOT_DEFECT_SCOPE),
            (is_blank(F.col("root_cause")), V.BLANK),
        ],
        F.coalesce("_defect_cause", F.lit(V.OTHER_ROOT_CAUSE)),
    )


def _shared_site() -> Column:
    return F.col("grp_location").isin(V.SHARED_SITES)


def _staff_under(people: People, role: str) -> Column:
    return people.is_in(F.col("asg_level6"), role) | people.is_in(F.col("rsv_level6"), role)


def _hub_robot() -> Column:
    return (F.col("assigned_to_individual") == V.HUB_ROBOT) | (F.col("resolved_by") == V.HUB_ROBOT)


def delivery_location(people: People) -> Column:
    manila = F.col("grp_delivery_group") == V.MANILA_HUBS
    works_in = lambda c: (F.col("asg_country") == c) | (F.col("rsv_country") == c)
    seattle_staff = F.col("assigned_to_individual").isin(
        [*people.logins("seattle_assignee"), V.TAO_ACCOUNT]
    )
    seattle_managed = people.is_in(F.col("asg_level5"), "seattle_manager")
    return first_match(
        [
            *[(manila & works_in(c), site) for c, site in V.MANILA_COUNTRY_SITES.items()],
            (_shared_site() & _staff_under(people, "costa_rica_manager"), V.COSTA_RICA_SITE),
            (_shared_site() & _staff_under(people, "india_manager"), V.INDIA_SITE),
            (_hub_robot(), V.INDIA_SITE),
            (seattle_staff, V.SEATTLE_SITE),
            (_shared_site() & seattle_managed, V.SEATTLE_SITE),
            (_shared_site(), F.coalesce("hub_default", F.lit(V.SEATTLE_SITE))),
        ],
        F.col("grp_location"),
    )


def delivery_group(people: People) -> Column:
    return first_match(
        [
            (_shared_site() & _staff_under(people, "costa_rica_manager"), V.COSTA_RICA_HUB),
            (_shared_site() & _staff_under(people, "india_group_manager"), V.INDIA_HUBS),
            (_hub_robot(), V.INDIA_HUBS),
            (_shared_site(), F.coalesce("hub_group", F.lit(V.OTHER))),
        ],
        F.col("grp_delivery_group"),
    )


def process() -> Column:
    by_group = F.col("assigned_to_group").isin(V.APAC_EXTENDED_ONBOARDING, V.EXTENDED_ONBOARDING)
    by_item = (F.col("grp_super_region") == V.EMEA) & (F.col("item") == V.EXTENDED_ONBOARDING_ITEM)
    shared = F.col("grp_process") == V.SHARED_PROCESS
    return first_match(
        [
            (by_group | by_item, V.EXTENDED_ONBOARDING_PROCESS),
            (shared, F.coalesce("cti_process", F.lit(V.OTHER))),
        ],
        F.col("grp_process"),
    )


def line_of_business(detail: str) -> Column:
    """``lob1`` or ``lob2``: the person concerned decides before the requester."""
    return F.coalesce(f"con_{detail}", f"req_{detail}", F.lit(V.OPERATIONS_LINE))


def plain_cause_group(options: Options) -> Column:
    """Root-cause group as far as ticket and lists settle it; null for what is left of the cases
    without a defect."""
    transfers = F.col("grp_process") == V.TRANSFERS
    no_defect = F.col("root_cause") == V.NO_DEFECT
    details, group = F.col("root_cause_details"), F.col("listed_root_group")
    blank = is_blank(F.col("root_cause"))
    unlisted = F.col("listed_root_cause").isNull()
    if options.covers(V.TRANSFERS):
        blank = blank | (transfers & is_blank(F.col("resolution")))
        unlisted = unlisted | (transfers & F.col("listed_resolution").isNull())
    return first_match(
        [
            (F.col("listed_resolution").isNotNull(), F.col("listed_resolution")),
            (blank, V.BLANK),
            (unlisted, V.OTHER_ROOT_CAUSE),
            (no_defect & contains_any(details, V.MISSING_INFO_WORDS), V.MISSING_INFO),
            (no_defect & contains_any(details, V.PROCESS_WORDS), V.PROCESS_DEPENDENCY),
            (no_defect, None),
            (group.isin(V.HRS_DEFECT, V.NO_DEFECT), V.LIFECYCLE_DEFECT),
        ],
        group,
    )


def with_lapse_times(cases: DataFrame) -> DataFrame:
    """Calendar time from creation to the last routing and the last reopening, where it counts."""
    no_defect = F.col("root_cause") == V.NO_DEFECT
    return cases.withColumns(
        {
            "routed_us": F.when(no_defect, business_us("create_date", "routed_date", 7)),
            "reopened_us": F.when(no_defect, business_us("create_date", "last_reopened_date", 7)),
        }
    )


def root_cause_group() -> Column:
    """Resolved cases only, after ``with_lapse_times`` and the target value."""
    no_defect = F.col("root_cause") == V.NO_DEFECT
    target_us = F.col("sla_taget_value") * F.lit(DAY_US)
    reopened_late = F.col("reopened_us") > target_us
    without_defect = first_match(
        [
            (F.col("routed_us") > target_us, V.ROUTED_LATE),
            (reopened_late & (F.col("reopened_by_system") == "Y"), V.REOPENED_BY_SYSTEM_LATE),
            (reopened_late & (F.col("reopened_by_system") == "N"), V.REOPENED_BY_PERSON_LATE),
            (no_defect & (F.col("pending") > 0), V.MISSING_INFO),
            (no_defect, V.LIFECYCLE_DEFECT),
        ]
    )
    return F.coalesce("plain_cause_group", without_defect)
