"""Employee snapshots and the roles people play in a case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.operators.latest import latest_with_ties
from casemetrics.operators.sizing import HOT_KEY_ROWS, Size, lookup_join

LEVELS = range(2, 10)


def employee_view(headcount: DataFrame) -> DataFrame:
    """Headcount rows with a login, renamed, logins in lower and manager logins in upper case."""
    managers = [
        F.upper(f"reports_to_level_{n}_employee_login").alias(f"reports_to_level{n}_login")
        for n in LEVELS
    ]
    return headcount.filter(F.col("employee_login").isNotNull()).select(
        "employee_login",
        "hr_begin_dt",
        F.trunc(F.to_date("hr_begin_dt"), "month").cast("timestamp_ntz").alias("dd_dt"),
        F.lower("employee_login").alias("login"),
        F.col("department_name").alias("dept_name"),
        F.col("department_id").alias("dept_id"),
        F.col("company_country_code").alias("country"),
        F.col("job_title_name").alias("job_title_nm"),
        F.col("job_level_name").alias("job_lvl_nm"),
        F.col("department_org_level1").alias("dept_org_level1"),
        F.col("department_org_level2").alias("dept_org_level2"),
        F.col("reports_to_supervisor_employee_name").alias("reports_to_supervisor"),
        *managers,
    )


def latest_employees(headcount: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Latest snapshot per login as spelled; ties and other spellings of a login stay."""
    latest = latest_with_ties(
        employee_view(headcount), ["employee_login"], "hr_begin_dt", hot_rows
    )
    return latest.drop("employee_login", "hr_begin_dt")


def join_person(
    df: DataFrame,
    people: DataFrame,
    login: str,
    prefix: str,
    columns: Sequence[str],
    where: Column | None = None,
    fits: bool | Size | None = None,
    hot_source: DataFrame | None = None,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Left join the person behind ``login``, any case, as ``prefix_<column>``.

    ``hot_source`` is the table that ``login`` comes from, in case the join must spread hot logins;
    for ``spread_by`` see ``lookup_join``.
    """
    key = f"_{prefix}_login"
    hot = None if hot_source is None else hot_source.select(F.lower(login).alias(key))
    side = people if where is None else people.filter(where)
    side = side.select(
        F.col("login").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns]
    )
    df = df.withColumn(key, F.lower(login))
    return lookup_join(df, side, [key], fits, spread_by=spread_by, hot_source=hot).drop(key)


def people_sets(people: DataFrame, name: str, prefix: str, columns: Sequence[str]) -> DataFrame:
    """Per login the distinct values of these columns as one set ``name``, for a join that must not
    multiply rows; ``with_each`` writes them out."""
    values = F.struct(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return people.groupBy("login").agg(F.collect_set(values).alias(name))


def with_each(df: DataFrame, name: str) -> DataFrame:
    """A row for each entry of the set ``name``, its values as columns; nulls where there is none."""
    entry = df.select("*", F.explode_outer(name).alias("_entry")).drop(name)
    return entry.select("*", "_entry.*").drop("_entry")
