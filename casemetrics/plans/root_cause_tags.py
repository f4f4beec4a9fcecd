"""The root-cause tag of each resolved case: its last root-cause mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.config.options import Options
from casemetrics.config.values import V, under_options
from casemetrics.operators.latest import latest_one
from casemetrics.sources.tables import CaseTables


@under_options
def root_cause_marks(audit: DataFrame, options: Options) -> DataFrame:
    """Root-cause marks since the cut-off, which prunes a trail stored by day."""
    recent = F.col("create_day") >= options.date("marks_from")
    marks = audit.filter(recent & (F.col("type") == V.ROOT_CAUSE_MARK))
    return marks.select("case_id", "modified_date", F.col("to_string").alias("root_cause_tag"))


@under_options
def root_cause_tags(tables: CaseTables, options: Options) -> DataFrame:
    """One row per case that was resolved since the cut-off and has a mark since then.

    A mark without a time counts as the last; of marks of one time
    one without text is taken, else the greatest text. Each
    task keeps its last mark of a case before the shuffle, and the cases meet the tags in the tasks
    where these lie.
    """
    last = latest_one(root_cause_marks(tables.audit, options), ["case_id"], "modified_date", ["root_cause_tag"])
    resolved = F.col("resolved_date") >= options.timestamp("marks_from")
    cases = tables.tickets.filter(resolved).select("case_id")
    return last.join(cases, "case_id", "left_semi").select("case_id", "root_cause_tag")
