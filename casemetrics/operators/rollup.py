"""Reductions of the audit trail to one row per case."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.functions.text import number_mark
from casemetrics.operators.latest import latest_in_one_pass
from casemetrics.operators.sizing import Size, lookup_join
from casemetrics.config.options import Options
from casemetrics.config.values import V, under_options

Merge = Callable[[Column | str], Column]
#: Name, the aggregate that also merges its own results, and the value of an event.
Measures = dict[str, tuple[Merge, Column]]


def _never() -> Column:
    return F.lit(V.NEVER).cast("timestamp_ntz")


def _mark_in(marks: list[str]) -> Column:
    return (F.col("type") == V.ROOT_CAUSE_MARK) & F.lower("to_string").isin(marks)


def _counts_for_rollup(options: Options) -> Column:
    """Events the roll-up looks at; severity and quicklink events only pass by description."""
    return (F.col("create_day") > options.date("audit_from")) & (
        F.col("type").isin(V.ROOT_CAUSE_MARK, V.REOPENING)
        | F.col("description").isin(V.GROUP_CHANGE, V.PENDING_REASON)
    )


def _is_correspondence(options: Options) -> Column:
    return (F.col("create_day") > options.date("correspondence_from")) & (
        F.col("type") == V.CORRESPONDENCE
    )


def _rollup_measures(scope: Column) -> Measures:
    """The measures of the roll-up, each null for a case without an event in scope."""
    event = F.col("type")
    text = F.col("to_string")

    def count(condition: Column) -> tuple[Merge, Column]:
        return F.sum, F.when(scope, F.when(condition, 1).otherwise(0))

    def first_mark(marks: list[str]) -> tuple[Merge, Column]:
        at = F.when(_mark_in(marks), F.col("modified_date")).otherwise(_never())
        return F.min, F.when(scope, at)

    rerouted = (F.col("description") == V.GROUP_CHANGE) & F.col("from_string").isNotNull()
    raised = (event == V.SEVERITY_CHANGE) & (
        F.substring("to_string", 1, 1) < F.substring("from_string", 1, 1)
    )
    counted = (event == V.ROOT_CAUSE_MARK) & (F.col("created_by") != V.ESCALATION_ROBOT)
    return {
        "four_a": count(_mark_in(V.FOUR_A_MARKS)),
        "four_r": count(_mark_in(V.FOUR_R_MARKS)),
        "four_c": count(_mark_in(V.FOUR_C_MARKS)),
        "four_f": count(_mark_in(V.FOUR_F_MARKS)),
        "four_na": count(_mark_in(V.FOUR_NA_MARKS)),
        "routed": count(rerouted),
        "pending": count(F.col("description") == V.PENDING_REASON),
        "reopened": count(event == V.REOPENING),
        "audit_root": count((event == V.ROOT_CAUSE_MARK) & F.lower(text).contains("audit")),
        "created_from_quicklink": count(event == V.QUICKLINK),
        "two_days": first_mark(V.TWO_DAY_MARKS),
        "five_days": first_mark(V.FIVE_DAY_MARKS),
        "case_count": (F.max, F.when(scope & counted, number_mark(text, V.NOT_COUNTS))),
        "escalated": count(raised),
    }


def _reduced(events: DataFrame, keys: Sequence[str], measures: Measures) -> DataFrame:
    """First level: every measure by key, in a hash aggregation of fixed-width values."""
    values = [merge(value).alias(name) for name, (merge, value) in measures.items()]
    return events.groupBy(*keys).agg(*values)


def _merged(measures: Measures) -> list[Column]:
    """Second level: the measures of a case from those of its parts."""
    return [merge(name).alias(name) for name, (merge, _) in measures.items()]


@under_options
def quicklink_texts(audit: DataFrame, options: Options) -> DataFrame:
    """Greatest quicklink text per case, of its different texts; equal ones become one map-side."""
    links = audit.filter(_counts_for_rollup(options) & (F.col("type") == V.QUICKLINK))
    different = links.select("case_id", "to_string").distinct()
    return different.groupBy("case_id").agg(F.max("to_string").alias("quicklink_text"))


@under_options
def audit_rollup(audit: DataFrame, options: Options) -> DataFrame:
    """Counts, first marks, case count and quicklink of each case with an event in scope.

    One pass over the trail. The events of a case are first reduced by quicklink text, as a key of
    the hash aggregation: a text as a maximum would turn it into a sort of all events. What is left
    of a case, a row for each of its different texts, is merged next.
    """
    scope = _counts_for_rollup(options)
    measures = _rollup_measures(scope)
    link = F.when(F.col("type") == V.QUICKLINK, F.col("to_string"))
    events = audit.filter(scope).withColumn("_link", link)
    reduced = _reduced(events, ["case_id", "_link"], measures)
    return reduced.groupBy("case_id").agg(*_merged(measures), F.max("_link").alias("quicklink_text"))


@under_options
def correspondence_counts(audit: DataFrame, options: Options) -> DataFrame:
    """Number of letters per case; a case without any has no row."""
    return (
        audit.filter(_is_correspondence(options))
        .groupBy("case_id")
        .agg(F.count("*").alias("correspondence_count"))
    )


def groups_of_process(groups: DataFrame, process: str) -> DataFrame:
    """Names of the resolver groups that belong to one process."""
    return groups.filter(F.col("dash_process") == process).select("resolver_group").distinct()


def _is_routing(options: Options) -> Column:
    return (
        (F.col("type") == V.ROUTING)
        & F.col("from_string").isNotNull()
        & (F.col("from_string") != V.AUTOMATION_QUEUE)
        & options.created_since("routing_from")
    )


def _is_reopening(options: Options) -> Column:
    return (F.col("type") == V.REOPENING) & options.created_since("routing_from")


def _reopened_by_system() -> Column:
    return F.when(F.col("created_by") == V.REOPENING_ROBOT, "Y").otherwise("N")


@under_options
def routing_events(
    audit: DataFrame, groups: DataFrame, options: Options, fits: bool | Size | None = None
) -> DataFrame:
    """Routings into a group of the benefits process, the automation queue left out."""
    events = audit.filter(_is_routing(options)).select(
        "case_id",
        "assigned_to",
        F.col("from_string").alias("routed_from"),
        F.col("to_string").alias("routed_to"),
        F.col("create_date").alias("routed_date"),
    )
    targets = groups_of_process(groups, V.BENEFITS).withColumnRenamed("resolver_group", "routed_to")
    return lookup_join(events, targets, ["routed_to"], fits, "left_semi")


@under_options
def reopening_events(
    audit: DataFrame, groups: DataFrame, options: Options, fits: bool | Size | None = None
) -> DataFrame:
    """Reopenings while the case lay with a group of the exits process."""
    events = audit.filter(_is_reopening(options)).select(
        "case_id",
        "assigned_to",
        _reopened_by_system().alias("reopened_by_system"),
        F.col("create_date").alias("last_reopened_date"),
    )
    exits = groups_of_process(groups, V.EXITS).withColumnRenamed("resolver_group", "assigned_to")
    return lookup_join(events, exits, ["assigned_to"], fits, "left_semi").drop("assigned_to")


def _kind_and_group(options: Options) -> list[Column]:
    """Whether an event is a routing or a reopening, and the group that decides if it counts."""
    routing, reopening = _is_routing(options), _is_reopening(options)
    return [
        F.when(routing, "routing").when(reopening, "reopening").alias("event"),
        F.when(routing, F.col("to_string")).when(reopening, F.col("assigned_to")).alias("_group"),
    ]


def groups_by_kind(groups: DataFrame) -> DataFrame:
    """Groups into which routings count, and groups with which reopenings count."""
    kind = F.when(F.col("dash_process") == V.BENEFITS, "routing").otherwise("reopening")
    wanted = groups.filter(F.col("dash_process").isin(V.BENEFITS, V.EXITS))
    return wanted.select(kind.alias("event"), F.col("resolver_group").alias("_group")).distinct()


@under_options
def last_events(
    audit: DataFrame, groups: DataFrame, options: Options, fits: bool | Size | None = None
) -> DataFrame:
    """All events of each case's last routing time and of its last reopening time.

    Both kinds are read once and ranked together, by case and kind. ``detail`` is the group routed to, or
    whether the system reopened the case.
    """
    routing = _is_routing(options)
    events = audit.filter(routing | _is_reopening(options)).select(
        "case_id",
        *_kind_and_group(options),
        F.col("create_date").alias("event_time"),
        F.when(routing, F.col("to_string")).otherwise(_reopened_by_system()).alias("detail"),
    )
    wanted = groups_by_kind(groups)
    found = lookup_join(events, wanted, ["event", "_group"], fits, "left_semi")
    found = found.select("case_id", "event", "event_time", "detail")
    return latest_in_one_pass(found, ["case_id", "event"], "event_time")


@under_options
def last_routing(audit: DataFrame, groups: DataFrame, options: Options) -> DataFrame:
    """All events of each case's last routing time."""
    return latest_in_one_pass(routing_events(audit, groups, options), ["case_id"], "routed_date")


@under_options
def last_reopening(audit: DataFrame, groups: DataFrame, options: Options) -> DataFrame:
    """All events of each case's last reopening time."""
    events = reopening_events(audit, groups, options)
    return latest_in_one_pass(events, ["case_id"], "last_reopened_date")


@under_options
def case_history(audit: DataFrame, options: Options) -> DataFrame:
    """Roll-up and correspondence of the open view in one pass over the trail.

    The audit trail is by far the largest input; every reduction by case shares one scan, one
    map-side aggregation and one shuffle.
    """
    scope, letter = _counts_for_rollup(options), _is_correspondence(options)
    measures = _history_measures(scope, letter)
    return _reduced(audit.filter(scope | letter), ["case_id"], measures)


def _history_measures(scope: Column, letter: Column) -> Measures:
    return {**_rollup_measures(scope), "correspondence_count": (F.sum, F.when(letter, 1))}


@under_options
def resolved_history(
    audit: DataFrame, groups: DataFrame, options: Options, fits: bool | Size | None = None
) -> DataFrame:
    """What the resolved view asks of the trail, in one pass: roll-up, correspondence, quicklink
    text, last reopenings and last routing.

    Events first shrink to a row per case, kind and detail (the group routed to, the quicklink text,
    neither) that holds the measures and the latest time: a maximum by key that merges map-side. A
    case then merges its few rows, and the details whose time equals its latest are the last ones;
    ties are kept. ``last_reopenings`` has at most two entries: the last reopening by the system and
    by a person when both happened at the same time.
    """
    scope, letter = _counts_for_rollup(options), _is_correspondence(options)
    kinds = groups_by_kind(groups).withColumn("_counts", F.lit(True))
    wanted = scope | letter | _is_routing(options) | _is_reopening(options)
    events = audit.filter(wanted).select("*", *_kind_and_group(options))
    events = lookup_join(events, kinds, ["event", "_group"], fits)
    routing = F.col("_counts") & (F.col("event") == "routing")
    reopening = F.col("_counts") & (F.col("event") == "reopening")
    robot = F.coalesce(F.col("created_by") == V.REOPENING_ROBOT, F.lit(False))
    link = scope & (F.col("type") == V.QUICKLINK)
    at = F.col("create_date")
    measures = _history_measures(scope, letter) | {
        "_system": (F.max, F.when(reopening & robot, at)),
        "_person": (F.max, F.when(reopening & ~robot, at)),
        "last_routed_date": (F.max, F.when(routing, at)),
    }
    detailed = events.withColumns(
        {
            "_kind": F.when(routing, "routing").when(link, "link"),
            "_detail": F.when(routing | link, F.col("to_string")),
        }
    )
    reduced = _reduced(detailed, ["case_id", "_kind", "_detail"], measures)
    target = F.struct(F.col("_detail").alias("group"), F.col("last_routed_date").alias("at"))
    of_case = reduced.groupBy("case_id").agg(
        *_merged(measures),
        F.max(F.when(F.col("_kind") == "link", F.col("_detail"))).alias("quicklink_text"),
        F.collect_list(F.when(F.col("_kind") == "routing", target)).alias("_targets"),
    )
    last = F.greatest("_system", "_person")

    def entry(name: str, label: str) -> Column:
        value = F.struct(F.lit(label).alias("by_system"), last.alias("at"))
        return F.when(F.col(name) == last, value)

    both = F.array_compact(F.array(entry("_system", "Y"), entry("_person", "N")))
    at_last = F.filter("_targets", lambda t: t["at"] == F.col("last_routed_date"))
    last_columns = {"last_reopenings": both, "last_routed_to": F.transform(at_last, lambda t: t["group"])}
    return of_case.withColumns(last_columns).drop("_system", "_person", "_targets")
