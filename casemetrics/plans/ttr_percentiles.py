"""Percentiles of the time to resolve per resolver group and month or week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.config.options import Options
from casemetrics.config.values import V, under_options
from casemetrics.functions.calendar import month_start, week_start
from casemetrics.functions.clock import END_STATES, as_days, with_time_to_resolve
from casemetrics.functions.text import not_in_or_null
from casemetrics.operators.percentiles import group_percentiles
from casemetrics.operators.sizing import lookup_join, stored
from casemetrics.sources.tables import CaseTables

MONTH_FRACTIONS = {"tp90onttr": 0.9}
WEEK_FRACTIONS = {"w_tp90onttr": 0.9, "w_tp75onttr": 0.75, "w_tp50onttr": 0.5, "w_tp25onttr": 0.25}


def reported_groups(groups: DataFrame) -> DataFrame:
    return groups.filter((F.col("report_switch") == 1) & (F.col("hrsd") == "Y"))


def grouping_key() -> Column:
    """Group, category, type and item in one text; null when a part is null."""
    return F.concat("assigned_to_group", "category", "type", "item")


def load_time(tables: CaseTables) -> Column:
    """Latest load time over all tickets, the "now" of open cases."""
    return tables.tickets.agg(F.max("dw_last_updated")).scalar()


@under_options
def mapped_resolved_cases(tables: CaseTables, options: Options) -> DataFrame:
    """Distinct case, group, resolution time and time to resolve of the cases in the mapping."""
    cases = tables.tickets.filter(
        (F.col("resolved_date") >= options.timestamp("percentiles_from"))
        & F.col("status").isin(END_STATES)
        & not_in_or_null(F.col("root_cause"), V.TEST_ROOT_CAUSES)
    ).withColumn("grouping", grouping_key())
    mapped = tables.transactions.select("grouping").distinct()
    calendars = reported_groups(tables.groups).select(
        F.col("resolver_group").alias("assigned_to_group"), "location", "days_week"
    )
    every = tables.tickets.withColumn("grouping", grouping_key())
    fits = tables.fits
    cases = lookup_join(
        cases, mapped, ["grouping"], fits["transactions"], "left_semi", hot_source=every
    )
    cases = lookup_join(
        cases, calendars.distinct(), ["assigned_to_group"], fits["groups"], hot_source=every
    )
    end = F.col("resolved_date")
    cases = with_time_to_resolve(cases, "ttr_us", end, source_zone=options.source_zone)
    return cases.select("case_id", "assigned_to_group", "resolved_date", "ttr_us").distinct()


def _in_days(df: DataFrame, names: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[as_days(F.col(n)).alias(n) for n in names])


@under_options
def monthly_percentiles(cases: DataFrame, options: Options) -> DataFrame:
    by_month = cases.withColumn("resolved_month", month_start("resolved_date"))
    keys = ["assigned_to_group", "resolved_month"]
    found = group_percentiles(by_month, keys, "ttr_us", MONTH_FRACTIONS, options.hot_group_rows)
    return _in_days(found, list(MONTH_FRACTIONS))


@under_options
def weekly_percentiles(cases: DataFrame, options: Options) -> DataFrame:
    by_week = cases.withColumn("resolved_week", week_start("resolved_date"))
    keys = ["assigned_to_group", "resolved_week"]
    found = group_percentiles(by_week, keys, "ttr_us", WEEK_FRACTIONS, options.hot_group_rows)
    return _in_days(found, list(WEEK_FRACTIONS))


@under_options
def ttr_percentiles(tables: CaseTables, options: Options) -> DataFrame:
    """Every mapped resolved case with the five percentiles of its group and period."""
    cases = stored(mapped_resolved_cases(tables, options))
    dated = cases.select(
        "case_id",
        "assigned_to_group",
        "resolved_date",
        as_days(F.col("ttr_us")).alias("ttr"),
        month_start("resolved_date").alias("resolved_month"),
        week_start("resolved_date").alias("resolved_week"),
    )
    months = stored(monthly_percentiles(cases, options))
    weeks = stored(weekly_percentiles(cases, options))
    dated = lookup_join(dated, months, ["assigned_to_group", "resolved_month"])
    dated = lookup_join(dated, weeks, ["assigned_to_group", "resolved_week"])
    return dated.drop("resolved_month", "resolved_week").select(
        "case_id", "assigned_to_group", "resolved_date", "ttr", *MONTH_FRACTIONS, *WEEK_FRACTIONS
    )
