"""Ordered rules: the first one that holds gives the value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Column, object]


def _value(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_match(rules: Sequence[Rule], default=None) -> Column:
    """Value of the first rule whose condition is true; a null condition counts as not met.

    One flat CASE: Spark splits its branches into small compiled methods, which it cannot do for
    conditions nested in each other.
    """
    if not rules:
        return _value(default)
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, _value(value))
    return chain.otherwise(_value(default))


def flag(condition: Column) -> Column:
    """``Y`` when the condition is true, ``N`` when it is false or null."""
    return F.when(condition, "Y").otherwise("N")
