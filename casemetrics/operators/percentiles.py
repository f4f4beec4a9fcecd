"""Exact interpolated percentiles per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemetrics.operators.sizing import SALTS, fits_broadcast

HOT_GROUP_ROWS = 50_000

# Bin widths of the search for a rank: days, seconds, single microseconds.
BIN_WIDTHS_US = [86_400_000_000, 1_000_000, 1]


def _matches(keys: Sequence[str], prefix: str) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def _prefixed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(prefix + k) for k in keys]


def _meet(
    rows: DataFrame, few: DataFrame, match: Column, how: str, salts: int = SALTS
) -> DataFrame:
    """Join rows to groups or bins of them: by broadcast if their counted size allows. Otherwise the
    rows of a group are spread by their columns and its entry is repeated for each part."""
    if fits_broadcast(few):
        return rows.join(F.broadcast(few), match, how)
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    every = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = rows.withColumn("_place", place)
    return placed.join(every, match & (F.col("_place") == F.col("_part")), how).drop("_place", "_part")


def _bin(value: str, width: int) -> Column:
    return F.col(value) - F.pmod(F.col(value), F.lit(width))


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value_us: str,
    fractions: Mapping[str, float],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """One row per key with one column per fraction, in microseconds.

    Groups below ``hot_rows`` use Spark's exact percentile aggregate, whose buffer holds the
    group's distinct values. Larger groups are searched by counting, see ``_search_ranks``; the
    largest size is looked up first, so that the search is planned only where it is needed. There
    are at most all rows / ``hot_rows`` such groups; they are broadcast only if their size allows.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(value_us).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    if largest < hot_rows:
        return _aggregate(df, keys, value_us, fractions)
    hot = sizes.filter(F.col("_rows") >= hot_rows)
    hot_keys = hot.select(*_prefixed(keys, "_hot_"))
    ordinary = _meet(df, hot_keys, _matches(keys, "_hot_"), "left_anti")
    large = _meet(df, hot_keys, _matches(keys, "_hot_"), "left_semi")
    return _aggregate(ordinary, keys, value_us, fractions).unionByName(
        _search_ranks(large, hot, keys, value_us, fractions)
    )


def _aggregate(
    df: DataFrame, keys: list[str], value_us: str, fractions: Mapping[str, float]
) -> DataFrame:
    every = F.percentile(F.col(value_us), list(fractions.values()))
    found = df.groupBy(*keys).agg(every.alias("_all"))
    return found.select(*keys, *[F.col("_all")[i].alias(n) for i, n in enumerate(fractions)])


def _search_ranks(
    df: DataFrame,
    sizes: DataFrame,
    keys: list[str],
    value_us: str,
    fractions: Mapping[str, float],
) -> DataFrame:
    """Find the values at the wanted ranks by counting into ever finer bins.

    Each pass counts per bin with map-side aggregation, so a task sees counts and never the group.
    A running sum over one group's bins locates each rank, and only that bin goes to the next
    pass. A group has at most one bin per day of its span, then 86,400 seconds, then a million
    microseconds; after the last pass the bin is the value.
    """
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in fractions.items()])
    )
    place = (F.col("_rows") - 1) * F.col("p")
    targets = (
        sizes.select(*keys, "_rows", wanted.alias("_w"))
        .select(*keys, "_rows", "_w.*")
        .select(*keys, "name", place.alias("place"))
        .select(
            *keys,
            "name",
            "place",
            F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank"),
        )
        .distinct()
        .withColumn("left", F.col("rank"))
    )

    within: list[str] = []
    rows = df.filter(F.col(value_us).isNotNull())
    for width in BIN_WIDTHS_US:
        scope = [*keys, *within]
        if within:
            bins = targets.select(*keys, F.col("base").alias("_outer")).distinct()
            bins = bins.select(*_prefixed(keys, "_t_"), "_outer")
            same_bin = _matches(keys, "_t_") & (F.col("_edge") == F.col("_outer"))
            edged = rows.withColumn("_edge", _bin(value_us, outer_width))
            rows_in = _meet(edged, bins, same_bin, "inner")
        else:
            rows_in = rows
        counts = rows_in.withColumn("_bin", _bin(value_us, width)).groupBy(*scope, "_bin").count()
        running = Window.partitionBy(*scope).orderBy("_bin")
        counts = counts.withColumn("_upto", F.sum("count").over(running))
        counts = counts.select(
            *_prefixed(keys, "_c_"),
            *within,
            "_bin",
            "_upto",
            (F.col("_upto") - F.col("count")).alias("_before"),
        )
        found = _matches(keys, "_c_")
        if within:
            found = found & (F.col("base") == F.col("_outer"))
        found = found & (F.col("left") >= F.col("_before")) & (F.col("left") < F.col("_upto"))
        targets = targets.join(counts, found).select(
            *keys,
            "name",
            "place",
            "rank",
            (F.col("left") - F.col("_before")).alias("left"),
            F.col("_bin").alias("base"),
        )
        within, outer_width = ["_outer"], width

    share = F.col("place") - F.floor("place")
    weight = F.when(F.col("rank") == F.floor("place"), 1 - share).otherwise(share)
    parts = targets.groupBy(*keys, "name").agg(F.sum(F.col("base") * weight).alias("value"))
    return parts.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in fractions]
    )
