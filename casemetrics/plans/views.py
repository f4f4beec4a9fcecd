"""The two case views: one row of metrics per open and per resolved case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.config.options import Options
from casemetrics.config.people import People
from casemetrics.config.values import V, under_options
from casemetrics.functions.buckets import age_bucket, correspondence_bucket, short_age_bucket
from casemetrics.functions.calendar import (
    closed_month,
    day_boundaries,
    month_label,
    second_label,
    week_label,
)
from casemetrics.functions.clock import as_days
from casemetrics.functions.text import strip_leading
from casemetrics.operators.rules import flag
from casemetrics.operators.sizing import as_of_build
from casemetrics.plans import attributes as A
from casemetrics.plans import sla
from casemetrics.plans.case_frame import case_frame
from casemetrics.sources.tables import CaseTables

Named = dict[str, Column]

RESOLUTION_MARKS = [
    "escalated",
    "hrs_supervisor",
    "4a",
    "4r",
    "4c",
    "4f",
    "root_cause_group",
    "created_from_quicklink",
    "quicklink_id",
    "defect",
]


def _as_is(*names: str) -> Named:
    return {name: F.col(name) for name in names}


def _positive(name: str) -> Column:
    return F.col(name) > 0


def identity(resolved: bool) -> Named:
    last = _as_is("resolution") if resolved else {"last_modified_type": F.lit("")}
    return {
        **_as_is("case_id", "assigned_to_group"),
        "superregion": F.col("grp_super_region"),
        "resolver_country": A.resolver_country(),
        **_as_is(
            "transaction_type",
            "category",
            "type",
            "item",
            "closure_code",
            "correspondence_count",
            "requester_login",
            "submitted_by",
            "assigned_to_individual",
            "resolved_by",
        ),
        **last,
        "correspondence_bucket": correspondence_bucket(F.col("correspondence_count")),
    }


def times(resolved: bool) -> Named:
    tp90 = F.col("tp90onttr") if resolved else F.lit(None).cast("double")
    return {
        "create_date": second_label("create_date"),
        "resolved_date_time": second_label("resolved_date"),
        "resolved_date": F.to_date("resolved_date"),
        "resolved_month": month_label("resolved_date"),
        "resolved_week": week_label("resolved_date"),
        "ttr": as_days(F.abs(F.col("ttr_us"))),
        "tp90onttr": tp90,
    }


def service_level(resolved: bool) -> Named:
    return {
        "sla_target_met": sla.sla_target_met(resolved),
        "sla_taget_value": F.col("sla_taget_value"),
        "sla_target_exists": sla.sla_target_exists(resolved),
    }


def case_weight() -> Named:
    return {"total_case_count": F.coalesce("case_count", F.lit(1))}


def delivery() -> Named:
    return {
        "year_month": closed_month("resolved_date"),
        "root_cause_details": F.col("root_cause_details"),
        **case_weight(),
        **_as_is("root_cause_defect", "delivery_location", "delivery_group"),
    }


def contact_flags() -> Named:
    again = _positive("reopened") | _positive("routed") | _positive("pending")
    return {
        "fcr": F.when(again, "N").otherwise("Y"),
        "reopened": flag(_positive("reopened")),
        "routed": flag(_positive("routed")),
        "pending": flag(_positive("pending")),
    }


def organisation() -> Named:
    return {
        "process": F.col("process"),
        "lob1": A.line_of_business("lob1"),
        "lob2": A.line_of_business("lob2"),
        "country": F.col("grp_country"),
        "assigned_date": F.col("assigned_date"),
    }


@under_options
def open_ages(options: Options) -> Named:
    now = options.run_time()
    age = day_boundaries(F.col("create_date"), now)
    return {
        "last_modified_by": F.col("last_modified_by"),
        "age_in_modified_days": day_boundaries(F.col("modified_date"), now),
        "modified_date": F.col("modified_date"),
        "hrs_supervisor": F.col("asg_supervisor"),
        "age_in_days": age,
        "age_days_bucket": age_bucket(age),
        "impact": F.col("impact"),
        "sev3_age_days_bucket": short_age_bucket(age),
        "status": F.col("status"),
        "etl_run_time": F.col("etl_run_time"),
    }


def mark_flags() -> Named:
    return {
        "escalated": flag(_positive("escalated")),
        "4a": flag(_positive("four_a")),
        "4r": flag(_positive("four_r")),
        "4c": flag(_positive("four_c")),
        "4f": flag(_positive("four_f")),
        "created_from_quicklink": flag(_positive("created_from_quicklink")),
        "defect": F.when(F.col("root_cause") == V.NO_DEFECT, "N").otherwise("Y"),
    }


def resolution_marks() -> Named:
    others = {
        "hrs_supervisor": F.col("asg_supervisor"),
        "root_cause_group": A.root_cause_group(),
        "quicklink_id": strip_leading(F.col("quicklink_text"), V.QUICKLINK_PREFIX_CHARACTERS),
    }
    columns = {**mark_flags(), **others}
    return {name: columns[name] for name in RESOLUTION_MARKS}


@under_options
def open_columns(options: Options) -> Named:
    return {
        **identity(resolved=False),
        **times(resolved=False),
        **service_level(resolved=False),
        **delivery(),
        "sla_days_bucket": as_days(F.col("ttr_us")),
        "sla_age_bucket": as_days(F.col("ttr_us")),
        **contact_flags(),
        **organisation(),
        **open_ages(options),
    }


def resolved_columns() -> Named:
    return {
        **identity(resolved=True),
        **times(resolved=True),
        **service_level(resolved=True),
        **delivery(),
        **contact_flags(),
        **organisation(),
        **resolution_marks(),
    }


#: Columns that a ticket settles on its own; they are written out once, before its rows multiply.
OWN = "create_date resolved_date_time resolved_month resolved_week ttr year_month".split()


def _settled_first(columns: Named) -> tuple[Named, Named]:
    """The ticket's own columns under other names, and the view's columns that take them from there."""
    own = {f"_own_{name}": columns[name] for name in OWN}
    return own, {**columns, **{name: F.col(f"_own_{name}") for name in OWN}}


@under_options
def view_frame(
    tables: CaseTables, people: People, options: Options, resolved: bool, own: Named | None = None
) -> DataFrame:
    """The settled frame with the target value, which the root-cause group builds on."""
    frame = case_frame(tables, people, options, resolved, own=own)
    return frame.withColumn("sla_taget_value", sla.sla_target_value(resolved))


def _view(frame: DataFrame, columns: Named) -> DataFrame:
    view = frame.select(*[column.alias(name) for name, column in columns.items()]).distinct()
    return as_of_build(view)


@under_options
def open_case_metrics(tables: CaseTables, people: People, options: Options) -> DataFrame:
    """One row per open case of the processes in scope, 53 columns."""
    own, columns = _settled_first(open_columns(options))
    return _view(view_frame(tables, people, options, resolved=False, own=own), columns)


@under_options
def resolved_case_metrics(tables: CaseTables, people: People, options: Options) -> DataFrame:
    """One row per resolved case of the processes in scope, 51 columns."""
    own, columns = _settled_first(resolved_columns())
    return _view(view_frame(tables, people, options, resolved=True, own=own), columns)
