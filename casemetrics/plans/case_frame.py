"""The frame behind both case views: tickets in scope with everything joined to them.

Order of the joins: first the ones that drop tickets, then lookups on other keys, and the joins on
``case_id`` last. The frame therefore ends up partitioned by ``case_id``, and the DISTINCT of the
views needs no further shuffle.

What group, category, type and item settle on their own is joined once for each combination that
occurs, not for each ticket: the tickets meet these five mapping tables in a single join.

Every step settles the result columns it can and drops the joined columns that no later step asks
for. Rows stay narrow in the shuffle, and each step compiles to methods small enough for the JIT.
A join copies its rows column by column but a struct as a whole, so columns that wait for the end
travel in one struct.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.config.options import Options
from casemetrics.config.people import People, broad_line
from casemetrics.config.values import V, under_options
from casemetrics.functions.calendar import month_start
from casemetrics.functions.clock import (
    BEIJING_AND_MANILA_SITES,
    BEIJING_SITES,
    END_STATES,
    with_time_to_resolve,
)
from casemetrics.functions.text import not_in_or_null
from casemetrics.operators.employees import employee_view, join_person, people_sets, with_each
from casemetrics.operators.key_filter import of_keys
from casemetrics.operators.latest import latest_with_ties
from casemetrics.operators.rollup import case_history, resolved_history
from casemetrics.operators.sizing import Size, compiled, lookup_join, size_of, stored
from casemetrics.plans import attributes as A
from casemetrics.plans import sla
from casemetrics.plans.ttr_percentiles import (
    grouping_key,
    load_time,
    mapped_resolved_cases,
    monthly_percentiles,
    reported_groups,
)
from casemetrics.sources.tables import CaseTables

PARTS = (
    "times",
    "targets",
    "orders",
    "causes",
    "people",
    "recent",
    "percentile",
    "history",
    "routing",
    "concerned",
)

CTI = ["category", "type", "item"]
REQUESTER = ["country", "lob1", "lob2", "level5"]

#: Columns that the steps after the tickets' own rules read, and those that the history reads; all others
#: travel in a struct. Nothing reads the columns without use, which would keep Spark from copying it whole.
ASKED = """case_id assigned_to_group item closure_code root_cause requester_login submitted_by resolved_by
    assigned_to_individual create_date resolved_date is_two_stage grp_location grp_process grp_delivery_group
    grp_defect_scope grp_defect_launch hub_default hub_group""".split()
ASKED_RESOLVED = ["category", "type", "resolution", "root_cause_details"]
ASKED_BY_HISTORY = "case_id assigned_to_group root_cause create_date is_two_stage _requester".split()
#: Narrow columns that tell tickets of one hot key apart, instead of a hash of whole rows at each join.
SPREAD_BY = ["case_id", "create_date", "submitted_by"]
WITHOUT_USE = ["create_day", "dw_last_updated", "effective_target"]

GROUP_COLUMNS = {
    "grp_location": "location",
    "grp_days_week": "days_week",
    "grp_super_region": "super_region",
    "grp_country": "country",
    "grp_delivery_group": "delivery_group",
    "grp_process": "dash_process",
    "grp_sla_target": "sla_target",
    "grp_sla_exists": "sla_target_exists",
    "grp_defect_scope": "defect_scope",
    "grp_defect_launch": "defect_launch",
}


@under_options
def open_tickets(tickets: DataFrame, options: Options) -> DataFrame:
    """A null status belongs to neither view."""
    return tickets.filter(
        (F.col("create_day") >= options.date("open_cases_from"))
        & ~F.col("status").isin(END_STATES)
        & not_in_or_null(F.col("root_cause"), V.TEST_ROOT_CAUSES)
    )


@under_options
def resolved_tickets(tickets: DataFrame, options: Options) -> DataFrame:
    return tickets.filter(
        (F.col("resolved_date") >= options.timestamp("resolved_cases_from"))
        & F.col("status").isin(END_STATES)
        & not_in_or_null(F.col("root_cause"), V.TEST_ROOT_CAUSES)
    )


@under_options
def in_scope(
    tickets: DataFrame, tables: CaseTables, options: Options, every: DataFrame | None = None
) -> DataFrame:
    """Keep tickets of a group with a process in scope, or of a shared group whose category and
    type have one.

    The group test alone implies an inner join, so it is made one, with the group's half of the
    condition on the small side. ``every`` holds the keys of ``tickets`` or more, by default those of
    all tickets, and is where hot keys are looked for; so in the functions below.
    """
    scope = options.processes()
    shared = V.SHARED_PROCESS.lower()
    process = F.lower("dash_process")
    groups = (
        reported_groups(tables.groups)
        .filter(process.isin([*scope, shared]))
        .select(
            F.col("resolver_group").alias("assigned_to_group"),
            *[F.col(source).alias(name) for name, source in GROUP_COLUMNS.items()],
        )
    )
    cti = tables.cti_process.select(
        "category",
        "type",
        F.col("country").alias("cti_country"),
        F.col("global_process").alias("cti_process"),
    )
    every = tables.tickets if every is None else every
    cases = lookup_join(
        tickets, groups, ["assigned_to_group"], tables.fits["groups"], "inner", hot_source=every
    )
    cases = lookup_join(
        cases, cti, ["category", "type"], tables.fits["cti_process"], hot_source=every
    )
    process = F.lower("grp_process")
    return cases.filter(
        process.isin(scope) | ((process == shared) & F.lower("cti_process").isin(scope))
    )


def with_cti_slas(cases: DataFrame, tables: CaseTables, every: DataFrame | None = None) -> DataFrame:
    """SLA target of category, type and item, as spelled."""
    targets = tables.cti_slas.select(*CTI, F.col("sla_target").alias("cti_sla_target"))
    fits, every = tables.fits["cti_slas"], tables.tickets if every is None else every
    return lookup_join(cases, targets, CTI, fits, hot_source=every)


def with_default_hubs(
    cases: DataFrame, tables: CaseTables, every: DataFrame | None = None
) -> DataFrame:
    """Default hub of category, type, item and group in any case."""
    keys = {"_category": "category", "_type": "type", "_item": "item", "_group": "assigned_to_group"}
    sources = {**keys, "_group": "resolver_group"}
    hubs = tables.default_hubs.select(
        *[F.lower(source).alias(key) for key, source in sources.items()],
        F.col("default_hub").alias("hub_default"),
        F.col("def_hub_group").alias("hub_group"),
        F.col("sla_target").alias("hub_sla_target"),
    )
    lowered = {key: F.lower(name) for key, name in keys.items()}
    every = (tables.tickets if every is None else every).withColumns(lowered)
    fits = tables.fits["default_hubs"]
    cases = cases.withColumns(lowered)
    return lookup_join(cases, hubs, list(keys), fits, hot_source=every).drop(*keys)


def with_transactions(
    cases: DataFrame, tables: CaseTables, every: DataFrame | None = None
) -> DataFrame:
    """Transaction type of the group as spelled and category, type and item in any case."""
    keys = {"_category": "category", "_type": "type", "_item": "item"}
    transactions = tables.transactions.select(
        "assigned_to_group",
        *[F.lower(name).alias(key) for key, name in keys.items()],
        F.col("transaction_type").alias("mapped_transaction"),
    )
    lowered = {key: F.lower(name) for key, name in keys.items()}
    every = (tables.tickets if every is None else every).withColumns(lowered)
    fits = tables.fits["transactions"]
    cases, all_keys = cases.withColumns(lowered), ["assigned_to_group", *keys]
    return lookup_join(cases, transactions, all_keys, fits, hot_source=every).drop(*keys)


def _spread_by(cases: DataFrame) -> list[str] | None:
    return [c for c in SPREAD_BY if c in cases.columns] or None


def packed(cases: DataFrame, name: str, asked: Collection[str]) -> DataFrame:
    """All columns but the ones asked for as one struct."""
    others = [c for c in cases.columns if c not in asked]
    return cases.select(*[c for c in cases.columns if c in asked], F.struct(*others).alias(name))


def unpacked(cases: DataFrame, name: str) -> DataFrame:
    return cases.select(*[c for c in cases.columns if c != name], f"{name}.*")


@under_options
def settled_desks(
    tickets: DataFrame, tables: CaseTables, options: Options, parts: Collection[str]
) -> DataFrame:
    """Combinations of group, category, type and item in scope, with what they settle on their own.

    A combination has a row for every way in which the mapping tables meet it, as each of its tickets
    would. ``_cti`` holds category, type and item, which may be null and then equal each other.
    """
    desks = stored(tickets.select("assigned_to_group", *CTI).distinct())
    found = in_scope(desks, tables, options, desks)
    found = found.withColumns({"known_country": A.known_country(), "process": A.process()})
    found = found.drop("cti_country", "cti_process")
    if "targets" in parts:
        found = with_default_hubs(with_cti_slas(found, tables, desks), tables, desks)
    if "orders" in parts:
        found = with_transactions(found, tables, desks)
    return stored(found.withColumn("_cti", F.struct(*CTI)).drop(*CTI))


def with_desks(cases: DataFrame, desks: DataFrame, tables: CaseTables) -> DataFrame:
    """Tickets of the given combinations with their columns; all others are dropped."""
    keys, cti = ["assigned_to_group", "_cti"], F.struct(*CTI)
    every = tables.tickets.withColumn("_cti", cti)
    cases, spread_by = cases.withColumn("_cti", cti), _spread_by(cases)
    return lookup_join(cases, desks, keys, how="inner", spread_by=spread_by, hot_source=every).drop("_cti")


def with_listed_cause(
    cases: DataFrame, tables: CaseTables, column: str, cause: str, group: str | None = None
) -> DataFrame:
    """Listed root cause, and if asked its group, that equals a ticket column in any case."""
    names = [F.col("root_cause").alias(cause)]
    if group:
        names.append(F.col("root_cause_group").alias(group))
    listed = tables.root_causes.select(F.lower("root_cause").alias("_listed"), *names)
    cases = cases.withColumn("_listed", F.lower(column))
    every = tables.tickets.withColumn("_listed", F.lower(column))
    fits = tables.fits["root_causes"]
    spread_by = _spread_by(cases)
    return lookup_join(cases, listed, ["_listed"], fits, spread_by=spread_by, hot_source=every).drop("_listed")


@under_options
def with_settled_causes(
    cases: DataFrame, tables: CaseTables, options: Options, resolved: bool
) -> DataFrame:
    """Root-cause columns; the listed causes are joined per column, as a list may repeat a cause."""
    cases = with_listed_cause(cases, tables, "root_cause", "_defect_cause")
    defect = A.root_cause_defect()
    cases = cases.withColumn("root_cause_defect", defect).drop(
        "_defect_cause", "grp_defect_scope", "grp_defect_launch"
    )
    if resolved:
        listed = ["listed_root_cause", "listed_root_group", "listed_resolution"]
        cases = with_listed_cause(cases, tables, "root_cause", *listed[:2])
        cases = with_listed_cause(cases, tables, "resolution", listed[2])
        cases = cases.withColumn("plain_cause_group", A.plain_cause_group(options)).drop(*listed)
    return cases


@under_options
def people_profiles(headcount: DataFrame, people: People, options: Options) -> DataFrame:
    """Latest snapshot of every login, cut down to what the rules ask."""
    view = employee_view(headcount).select(
        "employee_login",
        "hr_begin_dt",
        "login",
        "country",
        "dept_org_level1",
        F.col("reports_to_supervisor").alias("supervisor"),
        *[F.col(f"reports_to_level{n}_login").alias(f"level{n}") for n in (2, 5, 6, 7)],
    )
    latest = latest_with_ties(view, ["employee_login"], "hr_begin_dt", options.hot_rows)
    line = people.line_of_business(F.col("level2"), F.col("level5"), F.col("dept_org_level1"))
    profiles = latest.withColumn("lob2", line).withColumn("lob1", broad_line(F.col("lob2")))
    return stored(profiles.drop("employee_login", "hr_begin_dt", "dept_org_level1").distinct())


@under_options
def with_people(
    cases: DataFrame,
    tickets: DataFrame,
    profiles: DataFrame,
    people: People,
    options: Options,
    fits: bool | Size,
    in_sets: bool = False,
) -> DataFrame:
    """Requester, assignee, resolver and, where a rule asks, submitter.

    A login has a row for each latest snapshot and spelling, and every ticket multiplies by those of its
    requester, whom only the last columns read. ``in_sets`` leaves them as a set in ``_requester``
    for ``with_requester``; equal rows become one then.
    """
    staff = people.is_in(F.col("level2"), "hr_head")

    def join(login: str, prefix: str, columns: list[str], where: Column | None) -> DataFrame:
        return join_person(cases, profiles, login, prefix, columns, where, fits, tickets, _spread_by(cases))

    if in_sets:
        key, login = "_req_login", F.lower("requester_login")
        sets = people_sets(profiles, "_requester", "req", REQUESTER).withColumnRenamed("login", key)
        cases, every = cases.withColumn(key, login), tickets.select(login.alias(key))
        cases = lookup_join(cases, sets, [key], fits, spread_by=_spread_by(cases), hot_source=every).drop(key)
    else:
        cases = sla.with_managed(join("requester_login", "req", REQUESTER, None), people)
    assignee = ["country", "level5", "level6", "supervisor"]
    cases = join("assigned_to_individual", "asg", assignee, staff)
    cases = join("resolved_by", "rsv", ["country", "level6"], staff)
    if "hub_default" in cases.columns:
        cases = cases.withColumns(
            {
                "delivery_location": A.delivery_location(people),
                "delivery_group": A.delivery_group(people),
            }
        ).drop("hub_default", "hub_group")
    cases = cases.drop("asg_country", "asg_level5", "asg_level6", "rsv_country", "rsv_level6")
    if options.covers(V.ATTENDANCE):
        cases = join("submitted_by", "sub", ["level7"], staff)
    return cases


def with_requester(cases: DataFrame, people: People) -> DataFrame:
    """A row for each profile of the requester that ``with_people`` left in a set."""
    return sla.with_managed(with_each(cases, "_requester"), people)


@under_options
def concerned_people(
    concerned: DataFrame, profiles: DataFrame, options: Options, fits: bool | Size
) -> DataFrame:
    """Per case the distinct country and line of business of the people it concerns.

    A case may concern any number of logins, but the views only use these few values of them. The
    set of the values is small whatever the number of logins, and forms before the shuffle.
    """
    login = F.col("concerning_login")
    bridge = concerned.filter(
        (F.col("create_date") >= options.timestamp("concerned_from"))
        & login.isNotNull()
        & (F.lower(login) != "none")
    ).select("case_id", "concerning_login")
    columns = ["country", "lob1", "lob2"]
    known = join_person(
        bridge, profiles, "concerning_login", "con", columns, None, fits, concerned
    )
    values = F.struct("con_country", "con_lob1", "con_lob2")
    return known.groupBy("case_id").agg(F.collect_set(values).alias("_concerned"))


@under_options
def recent_staff(tickets: DataFrame, options: Options) -> DataFrame:
    """Assignees of the two onboarding teams in the 30 days before the run, one row per login."""
    today = F.to_date(options.run_time())
    day = F.to_date("resolved_date")
    extended = F.col("assigned_to_group") == V.EXTENDED_ONBOARDING
    onboarding = F.col("assigned_to_group").isin(V.ONBOARDING_GROUPS)
    return (
        tickets.filter(
            (extended | onboarding)
            & day.between(F.date_sub(today, 30), F.date_sub(today, 1))
            & F.col("assigned_to_individual").isNotNull()
        )
        .groupBy(F.col("assigned_to_individual").alias("submitted_by"))
        .agg(F.max(extended).alias("recent_extended"), F.max(onboarding).alias("recent_onboarding"))
    )


@under_options
def with_monthly_percentile(cases: DataFrame, tables: CaseTables, options: Options) -> DataFrame:
    """Percentile of the case's group and month, for cases that took part in it."""
    timed = stored(mapped_resolved_cases(tables, options))
    months = stored(monthly_percentiles(timed, options))
    mapped = tables.transactions.select("grouping", F.lit(True).alias("_mapped")).distinct()
    keys = {"grouping": grouping_key(), "resolved_month": month_start("resolved_date")}
    cases, every = cases.withColumns(keys), tables.tickets.withColumns(keys)
    fits, spread_by = tables.fits["transactions"], _spread_by(cases)
    cases = lookup_join(cases, mapped, ["grouping"], fits, spread_by=spread_by, hot_source=every)
    period = ["assigned_to_group", "resolved_month"]
    cases = lookup_join(cases, months, period, spread_by=spread_by, hot_source=every)
    took_part = F.col("_mapped") & (F.col("resolved_date") >= options.timestamp("percentiles_from"))
    return cases.withColumn("tp90onttr", F.when(took_part, F.col("tp90onttr"))).drop(
        "grouping", "resolved_month", "_mapped"
    )


@under_options
def with_times(cases: DataFrame, now: Column, options: Options) -> DataFrame:
    """Load time and the time to resolve on the two calendars the views use."""
    place = {"location": "grp_location", "days_week": "grp_days_week"}
    end, zone = F.col("etl_run_time"), options.source_zone
    cases = cases.withColumn("etl_run_time", now)
    cases = with_time_to_resolve(cases, "ttr_us", end, BEIJING_AND_MANILA_SITES, source_zone=zone, **place)
    return with_time_to_resolve(cases, "sla_ttr_us", end, BEIJING_SITES, source_zone=zone, **place)


@under_options
def with_history(
    cases: DataFrame, tables: CaseTables, options: Options, resolved: bool, of_view: DataFrame
) -> DataFrame:
    """Reductions of the audit trail by case, of the cases of the view alone."""
    audit = of_keys(tables.audit, "case_id", of_view, options.key_filter_words)
    if not resolved:
        return cases.join(case_history(audit, options), "case_id", "left")
    history = resolved_history(audit, tables.groups, options, tables.fits["groups"])
    cases = cases.join(history, "case_id", "left")
    cases = cases.select("*", F.explode_outer("last_reopenings").alias("_reopening"))
    reopening = {
        "reopened_by_system": F.col("_reopening.by_system"),
        "last_reopened_date": F.col("_reopening.at"),
    }
    return cases.withColumns(reopening).drop("_reopening", "last_reopenings")


def with_routing(cases: DataFrame) -> DataFrame:
    """Last routing time, where the last routing led to the case's own group."""
    own = F.array_contains("last_routed_to", F.col("assigned_to_group"))
    cases = cases.withColumn("routed_date", F.when(own, F.col("last_routed_date")))
    return cases.drop("last_routed_to", "last_routed_date")


@under_options
def case_frame(
    tables: CaseTables,
    people: People,
    options: Options,
    resolved: bool,
    parts: Collection[str] = PARTS,
    own: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Tickets of one view with the named parts joined and settled.

    ``own`` adds columns over the tickets and their times, written out before rows multiply. It marks a
    view, which reads nearly all columns and keeps different rows only; columns that wait are packed then, and
    requesters travel in sets. Who reads few has the others pruned.
    """
    compiled(tables.tickets.sparkSession)
    select = resolved_tickets if resolved else open_tickets
    cases = select(tables.tickets, options)
    cases = with_desks(cases, settled_desks(cases, tables, options, parts), tables)
    if not {"history", "routing", "concerned"}.isdisjoint(parts):
        of_view = stored(cases.select("case_id"))
    if "times" in parts:
        cases = with_times(cases, load_time(tables), options).drop("grp_days_week")
    if "targets" in parts:
        cases = sla.with_targets(cases, resolved)
    if "targets" in parts and "times" in parts:
        cases = sla.with_time_verdict(cases)
    if "orders" in parts:
        cases = cases.withColumn("transaction_type", A.transaction_type(resolved))
        cases = sla.with_support_orders(cases) if resolved else cases
        cases = cases.drop("mapped_transaction")
    cases = cases.withColumns(dict(own or {}))
    long_way = own is not None
    if long_way:
        asked = [*ASKED, *ASKED_RESOLVED] if resolved else ASKED
        cases = packed(cases.drop(*WITHOUT_USE), "_settled", asked)
    if "causes" in parts:
        cases = with_settled_causes(cases, tables, options, resolved)
    if "people" in parts or "concerned" in parts:
        profiles = people_profiles(tables.headcount, people, options)
        few_people = size_of(profiles)
    if "people" in parts:
        cases = with_people(cases, tables.tickets, profiles, people, options, few_people, long_way)
    if "recent" in parts:
        recent = stored(recent_staff(tables.tickets, options))
        spread_by = _spread_by(cases)
        cases = lookup_join(cases, recent, ["submitted_by"], spread_by=spread_by, hot_source=tables.tickets)
        cases = sla.with_exemptions(cases, people, options)
    if "percentile" in parts and resolved:
        cases = with_monthly_percentile(cases, tables, options)
    if long_way:
        cases = packed(cases, "_joined", ASKED_BY_HISTORY)
    if "history" in parts or "routing" in parts:
        cases = with_history(cases, tables, options, resolved, of_view)
    if "history" in parts and "targets" in parts:
        cases = sla.with_stages(cases)
    if "routing" in parts and resolved:
        cases = A.with_lapse_times(with_routing(cases))
    if "concerned" in parts:
        bridge = tables.concerned.withColumnRenamed("ticket_case_id", "case_id")
        bridge = of_keys(bridge, "case_id", of_view, options.key_filter_words)
        concerned = concerned_people(bridge, profiles, options, few_people)
        cases = cases.join(concerned, "case_id", "left")
        cases = with_each(cases, "_concerned")
    if long_way and "people" in parts:
        cases = with_requester(cases, people)
    if long_way:
        cases = unpacked(unpacked(cases, "_joined"), "_settled")
    return cases
