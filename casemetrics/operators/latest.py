"""The latest rows of each key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemetrics.operators.sizing import HOT_KEY_ROWS


def latest_with_ties(
    df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Rows of rank 1 by ``order`` descending, a null counting as the latest; ties are kept.

    Spark cuts each map task to its own rank-1 rows before the shuffle, but ties survive that cut.
    So the rows of a hot key are not ranked: those that equal its best value are the answer, and
    they stay in the tasks that read them.
    """
    best = _best_of_hot_keys(df, keys, order, hot_rows)
    if best is None:
        return _rank_one(df, keys, order).select(*df.columns)
    same_key = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    marked = df.join(F.broadcast(best), same_key, "left")
    of_hot_key = F.col("_best_is_null").isNotNull()
    is_best = F.when(F.col("_best_is_null"), F.col(order).isNull()).otherwise(
        F.col(order) == F.col("_best")
    )
    others = _rank_one(marked.filter(~of_hot_key), keys, order).select(*df.columns)
    return others.unionByName(marked.filter(of_hot_key & is_best).select(*df.columns))


def _best_of_hot_keys(
    df: DataFrame, keys: Sequence[str], order: str, hot_rows: int
) -> DataFrame | None:
    """The best value of each key with at least ``hot_rows`` rows, from one grouped pass; there are
    at most as many as the rows divided by ``hot_rows``. None where no key is hot."""
    of_key = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(
        F.count("*").alias("_n"),
        F.max(order).alias("_best"),
        F.max(F.col(order).isNull()).alias("_best_is_null"),
    )
    hot = of_key.filter(F.col("_n") >= hot_rows).drop("_n")
    rows = hot.collect()
    return df.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def _rank_one(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    best_first = Window.partitionBy(*keys).orderBy(F.desc_nulls_first(order))
    return df.withColumn("_rank", F.rank().over(best_first)).filter("_rank = 1")


#: Copies of a row that are made at once.
COPIES = 1000


def latest_in_one_pass(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of rank 1 by ``order`` descending, a null counting as the latest; ties are kept.

    The input is read once. Equal rows first become one row and their number, map-side, so any
    number of them is one row in the shuffle, and rows of one key are dealt by all columns. Then
    each task keeps the best rows it has of a key before a key's rows meet. For narrow rows whose
    ties are few different ones; else see ``latest_with_ties``.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    best = _rank_one(counted, keys, order)
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))
    in_blocks = best.withColumn("_block", F.explode(blocks))
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("_n") - F.col("_block") * COPIES))
    return in_blocks.withColumn("_copy", F.explode(copies)).select(*df.columns)


def latest_one(
    df: DataFrame, keys: Sequence[str], order: str, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Exactly one row per key: the latest, ties settled by the ``tie_break`` columns descending.

    At most one row per key and map task reaches the shuffle.
    """
    best_first = Window.partitionBy(*keys).orderBy(
        F.desc_nulls_first(order), *[F.desc_nulls_first(c) for c in tie_break]
    )
    ranked = df.withColumn("_row", F.row_number().over(best_first))
    return ranked.filter("_row = 1").drop("_row")
