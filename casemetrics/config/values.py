"""The values that rules compare with: the fixed ones, or others from a table.

Groups, items, labels, accounts, queues and targets are rows of a table with the columns ``name``,
``key`` and ``value``, named as in ``fixed_values``. A text or number takes one row, a list one row
per entry (a single row without a value empties it), a mapping one row per key. Names without rows
keep their fixed value. The table lists what rules spell out, so it does not grow with the cases.

Rules read a value as ``V.NAME`` while their columns are built. Functions that take ``Options`` are
marked with ``under_options`` and put the values of these options in force for that time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from casemetrics.config import fixed_values
from casemetrics.operators.sizing import within

Row = tuple[str, str | None, str | None]

#: Names that a table may set; dates are options of their own.
NAMES = sorted(
    name for name in vars(fixed_values) if name.isupper() and name != "NEVER" and not name.endswith("_FROM")
)


def _read(name: str, rows: list[tuple[str | None, str | None]]):
    fixed = getattr(fixed_values, name)
    values = [value for _, value in rows]
    if isinstance(fixed, list):
        if None in values and len(values) > 1:
            raise ValueError(f"{name}: a row without a value empties the list and must stand alone")
        return [v for v in values if v is not None]
    if None in values:
        raise ValueError(f"{name}: a row lacks its value")
    if isinstance(fixed, Mapping):
        if None in dict(rows) or len(dict(rows)) < len(rows):
            raise ValueError(f"{name}: every row needs a key of its own")
        return dict(rows)
    if len(values) > 1:
        raise ValueError(f"{name}: one row expected, not {len(values)}")
    return type(fixed)(values[0])


@dataclass(frozen=True)
class RuleValues:
    """Values by name that take the place of the fixed ones."""

    values: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[Row]) -> RuleValues:
        by_name: dict[str, list] = {}
        for name, key, value in rows:
            by_name.setdefault(name, []).append((key, value))
        unknown = set(by_name) - set(NAMES)
        if unknown:
            raise ValueError(f"unknown values {sorted(unknown)}")
        return cls({name: _read(name, rows) for name, rows in by_name.items()})

    @classmethod
    def from_table(cls, df: DataFrame) -> RuleValues:
        rows = df.select("name", "key", "value").distinct().orderBy("name", "key", "value")
        return cls.of(tuple(row) for row in rows.collect())


_IN_FORCE: ContextVar[Mapping[str, object]] = ContextVar("rule_values", default={})


class _Values:
    """The value in force of each name."""

    def __getattr__(self, name: str):
        if name in (given := _IN_FORCE.get()):
            return given[name]
        return getattr(fixed_values, name)


V = _Values()


def under_options(build: Callable) -> Callable:
    """Put the values of the options among a function's arguments in force while it builds, and the
    budget that its joins share; functions it calls join the same budget."""

    @functools.wraps(build)
    def run(*args, **named):
        options = next((a for a in [*args, *named.values()] if isinstance(getattr(a, "rule_values", None), RuleValues)), None)
        if options is None:
            return build(*args, **named)
        token = _IN_FORCE.set(options.rule_values.values)
        try:
            with within(options.budget()):
                return build(*args, **named)
        finally:
            _IN_FORCE.reset(token)

    return run
