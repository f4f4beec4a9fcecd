"""Text tests and text-to-number reading."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowered(name: str) -> Column:
    return F.lower(F.col(name))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when the lowered text holds one of the words."""
    low = F.lower(text)
    return reduce(or_, [low.contains(word) for word in words])


def not_in_or_null(value: Column, excluded: Sequence[str]) -> Column:
    """Exclusion list that keeps null values."""
    return value.isNull() | ~value.isin(list(excluded))


def is_blank(value: Column) -> Column:
    """Null, or the one-letter stand-in for it."""
    return value.isNull() | (value == "x")


def strip_leading(value: Column, characters: str) -> Column:
    """Drop leading characters as long as they belong to the set."""
    return F.ltrim(value, F.lit(characters))


def number_mark(text: Column, not_marks: Sequence[str], max_length: int = 3) -> Column:
    """The count written as a short text mark, else null.

    The range test compares text with text, so a mark must start with a digit from 1 to 9; marks
    that then fail to read as a number give null.
    """
    looks_like_count = (
        text.between("1", "9999")
        & ~F.lower(text).isin(list(not_marks))
        & (F.length(text) <= max_length)
    )
    return F.when(looks_like_count, F.try_to_number(text, F.lit("9999")).cast("int"))
