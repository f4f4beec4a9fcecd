"""Queries by name, each with the SQL that gives the same result elsewhere."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemetrics.sources.tables import CaseTables
from workload.roles import ROLE_SQL, RoleTables


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str
    build: Callable[[CaseTables | RoleTables], DataFrame] | None = None


REGISTRY: dict[str, Entry] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Percentiles to nine digits: engines interpolate with different last bits. Every other
    number is exact on both sides."""
    percentiles = [name for name in df.columns if re.fullmatch(r"(w_)?tp\d+onttr", name)]
    return df.withColumns({name: F.round(name, 9) for name in percentiles})


def with_roles(body: str, named: Mapping[str, str] | None = None) -> str:
    """SQL text preceded by the named intermediates and the role tables it reads."""
    named = dict(named or {})
    text = " ".join([*named.values(), body])
    used = [r for r in ROLE_SQL if re.search(rf"\b(FROM|JOIN) {r}\b", text)]
    parts = [f"{name} AS ({ROLE_SQL[name]})" for name in used]
    parts += [f"{name} AS ({sql})" for name, sql in named.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(name: str, sql: str, named: Mapping[str, str] | None = None, tables=RoleTables):
    """Register a function of the role tables under ``name``."""

    def register(build: Callable[[CaseTables | RoleTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(tables(spark, sf_dir)))

        REGISTRY[name] = Entry(run, with_roles(sql, named), build)
        return build

    return register


def given_query(name: str, sql: str):
    """Register a function of the given tables' folder under ``name``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Entry(lambda spark, sf_dir: tidy(build(spark, sf_dir)), with_roles(sql))
        return build

    return register
