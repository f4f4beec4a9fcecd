"""Labels for counts and day ages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column

from casemetrics.operators.rules import first_match

# First and last value of each range, with its label.
CORRESPONDENCE_RANGES = [(0, 4, "1 to 3"), (4, 10, "4 to 10"), (11, 26, "11 to 25")]
CORRESPONDENCE_ABOVE = (25, ">25")

# Labels by the first age beyond the bin, and the label of the open end.
AGE_BINS = [
    (5, "0 to 5"),
    (11, "05 to 10"),
    (16, "11 to 15"),
    (21, "16 to 20"),
    (26, "21 to 25"),
    (31, "26 to 30"),
    (61, "31 to 60"),
    (91, "61 to 90"),
    (121, "91 to 120"),
]
AGE_ABOVE = "Above 120"
SHORT_AGE_BINS = [
    (3, "0 to 2"),
    (6, "3 to 5"),
    (9, "6 to 8"),
    (12, "9 to 11"),
    (15, "12 to 14"),
]
SHORT_AGE_ABOVE = "Above 15"


def correspondence_bucket(count: Column) -> Column:
    """The first range that holds the count; the ranges overlap at their edges on purpose."""
    edge, above = CORRESPONDENCE_ABOVE
    ranges = [(count.between(low, high), name) for low, high, name in CORRESPONDENCE_RANGES]
    return first_match([*ranges, (count > edge, above)])


def bin_below(value: Column, bins: Sequence[tuple[int, str]], above: str) -> Column:
    """Label of the first bin whose upper edge lies beyond the value; null for null."""
    below = [(value < edge, name) for edge, name in bins]
    return first_match([*below, (value.isNotNull(), above)])


def age_bucket(age: Column) -> Column:
    return bin_below(age, AGE_BINS, AGE_ABOVE)


def short_age_bucket(age: Column) -> Column:
    return bin_below(age, SHORT_AGE_BINS, SHORT_AGE_ABOVE)
