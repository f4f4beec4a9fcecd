"""Size checks, stored intermediates and skew-proof lookups.

A lookup side is broadcast only after its rows and bytes were counted. A side beyond the limit is
joined by shuffle, with the rows of hot keys and of null keys spread over several tasks. The joins of
one plan share a budget: each broadcast is booked, as an executor holds all of them at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of all sides that the joins of one plan broadcast.
PLAN_BROADCAST_BYTES = 4 * MAX_BROADCAST_BYTES
HOT_KEY_ROWS = 1_000_000
SALTS = 64
#: Hot keys that a plan names one by one; more of them are met by a join with their hashes.
LISTED_KEYS = 2_000
#: Hot keys that are told apart at all; with more of them, a key is hot from twice as many rows on.
MOST_HOT_KEYS = MAX_BROADCAST_ROWS


@dataclass(frozen=True)
class Size:
    """Counted rows and value bytes of a side; true if one broadcast of it is within the limits."""

    rows: int
    bytes: int

    def fits(self, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
        """Limits not named are those of the budget in force, or else of the module."""
        budget = _BUDGET.get() or Budget()
        limits = [(max_rows, budget.max_rows, MAX_BROADCAST_ROWS), (max_bytes, budget.max_bytes, MAX_BROADCAST_BYTES)]
        most_rows, most_bytes = (next(v for v in given if v is not None) for given in limits)
        return self.rows <= most_rows and self.bytes <= most_bytes

    def __bool__(self) -> bool:
        return self.fits()


@dataclass
class Budget:
    """Limits of the joins of one plan, and the sizes of the broadcasts granted so far.

    A side is booked once for every join that uses it, since each join builds a table of its own.
    Joins are served in the order in which the plan is built; what finds no room joins by shuffle.
    ``max_rows`` and ``max_bytes`` bound a single side, by default as the module says.
    """

    max_rows: int | None = None
    max_bytes: int | None = None
    plan_bytes: int = PLAN_BROADCAST_BYTES
    hot_rows: int = HOT_KEY_ROWS
    booked: list[Size] = field(default_factory=list)

    def book(self, size: Size) -> bool:
        room = self.plan_bytes - sum(s.bytes for s in self.booked)
        if not size or size.bytes > room:
            return False
        self.booked.append(size)
        return True


_BUDGET: ContextVar[Budget | None] = ContextVar("budget", default=None)


@contextmanager
def within(budget: Budget) -> Iterator[Budget]:
    """Put a budget in force for the joins built inside; one that is in force already stays."""
    given = _BUDGET.get()
    if given is not None:
        yield given
        return
    token = _BUDGET.set(budget)
    try:
        yield budget
    finally:
        _BUDGET.reset(token)


def _hot_rows(hot_rows: int | None) -> int:
    budget = _BUDGET.get()
    return hot_rows or (budget.hot_rows if budget else HOT_KEY_ROWS)


def may_broadcast(fits: bool | Size) -> bool:
    """Whether a side may be broadcast once more; a counted size is booked by the plan in force."""
    budget = _BUDGET.get()
    return bool(fits) if budget is None or not isinstance(fits, Size) else budget.book(fits)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may fall back to its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casemetrics-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Compute once into a columnar table of the shared folder and read it back.

    The parts are computed a single time. Later reads take the columns they ask for, with their
    filters pushed down, and a lost executor costs no recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a method from which on HotSpot interprets it forever.
JIT_BYTES = 8000


def compiled(spark: SparkSession) -> None:
    """Have stages whose generated method would be too long for the JIT run operator by operator.

    The joins and rules of a view fuse into one stage with a method of some 35,000 bytes, which runs
    interpreted. Taken singly, each operator compiles to short methods. No result depends on it.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_BYTES)


#: Marks the first column of a frame with parts that were stored while it was built.
AS_OF_BUILD = "casemetrics.as_of_build"


def as_of_build(df: DataFrame) -> DataFrame:
    """The frame with that mark, which follows it through projections and filters."""
    return df.withMetadata(df.columns[0], {AS_OF_BUILD: True})


def _row_bytes(df: DataFrame) -> Column:
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        else:
            width = width + 16
    return width.cast("bigint")


def _size_row(df: DataFrame, name: str) -> DataFrame:
    size = df.select(_row_bytes(df).alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    return size.select(F.lit(name).alias("name"), "n", F.coalesce("b", F.lit(0)).alias("b"))


def sizes(frames: Mapping[str, DataFrame]) -> dict[str, Size]:
    """Count rows and value bytes of several frames in one job; two numbers per frame come back."""
    counted = reduce(DataFrame.unionAll, [_size_row(df, name) for name, df in frames.items()])
    return {row["name"]: Size(row["n"], row["b"]) for row in counted.collect()}


def size_of(df: DataFrame) -> Size:
    return sizes({"side": df})["side"]


def which_fit(
    frames: Mapping[str, DataFrame], max_rows: int | None = None, max_bytes: int | None = None
) -> dict[str, bool]:
    """For several frames whether each alone is within the limits."""
    return {name: size.fits(max_rows, max_bytes) for name, size in sizes(frames).items()}


def fits_broadcast(
    df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None
) -> bool:
    return which_fit({"side": df}, max_rows, max_bytes)["side"]


def hot_key_hashes(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_KEY_ROWS, keep_null: bool = False
) -> list[int]:
    """Hashes of all keys that hold at least ``hot_rows`` rows, by a count that is combined map-side.

    There are at most as many as the rows divided by ``hot_rows``. The list only decides where rows
    travel: a hash two keys share changes no result. Looking first keeps the plan plain where
    nothing is hot.
    """
    rows = df if keep_null else df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    counts = rows.select(F.xxhash64(*keys).alias("_key")).groupBy("_key").agg(F.count("*").alias("_n"))
    return sorted(row["_key"] for row in counts.filter(F.col("_n") >= hot_rows).select("_key").collect())


def find_hot(df: DataFrame, keys: Sequence[str], hot_rows: int) -> list[int] | DataFrame:
    """Hashes of the keys that hold at least ``hot_rows`` rows: a short list, or a frame of ``_key``.

    Neither the plan nor the driver grows with the hot keys. Beyond ``MOST_HOT_KEYS`` the bound on
    rows is doubled until they fit; a key that is ordinary then holds at most two parts in
    ``MOST_HOT_KEYS`` of all rows, or fewer than ``hot_rows``.
    """
    rows = df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    counts = rows.select(F.xxhash64(*keys).alias("_key")).groupBy("_key").agg(F.count("*").alias("_n"))
    hot = stored(counts.filter(F.col("_n") >= hot_rows))
    listed = hot.select("_key").limit(LISTED_KEYS + 1).collect()
    if len(listed) <= LISTED_KEYS:
        return sorted(row["_key"] for row in listed)
    while hot.count() > MOST_HOT_KEYS:
        hot_rows *= 2
        hot = hot.filter(F.col("_n") >= hot_rows)
    return hot.select("_key")


def is_hot(keys: Sequence[str], hot: Sequence[int]) -> Column:
    return F.xxhash64(*keys).isin(list(hot)) if hot else F.lit(False)


def with_mark(df: DataFrame, keys: Sequence[str], hot: Sequence[int] | DataFrame) -> DataFrame:
    """Add ``_hot``, whether a key is hot; rows meet a frame of hashes where they are."""
    if not isinstance(hot, DataFrame):
        return df.withColumn("_hot", is_hot(keys, hot))
    hashes = F.broadcast(hot.select(F.col("_key").alias("_hot_key")))
    marked = df.join(hashes, F.xxhash64(*[df[k] for k in keys]) == F.col("_hot_key"), "left")
    return marked.withColumn("_hot", F.col("_hot_key").isNotNull()).drop("_hot_key")


def with_salt(
    df: DataFrame,
    keys: Sequence[str],
    hot: Sequence[int] | DataFrame,
    spread_by: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Add ``_salt``: 0 for ordinary keys, a hash of ``spread_by`` for hot and for null keys.

    The salt follows from the row alone, so a rerun task gives every row its place again.
    """
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    any_null = reduce(or_, [F.col(k).isNull() for k in keys])
    salt = F.when(any_null | F.col("_hot"), spread).otherwise(0)
    return with_mark(df, keys, hot).withColumn("_salt", salt).drop("_hot")


def salted_left_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    hot_rows: int | None = None,
    salts: int = SALTS,
    hot_source: DataFrame | None = None,
) -> DataFrame:
    """Left join by shuffle; lookup rows of hot keys are repeated once per salt, no others.

    ``hot_source`` holds the same key columns closer to a stored table, so that looking for hot
    keys does not run the joins behind ``fact``.
    """
    hot = find_hot(fact if hot_source is None else hot_source, keys, _hot_rows(hot_rows))
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salts_of_key = F.when(F.col("_hot"), every_salt).otherwise(F.array(F.lit(0)))
    repeated = with_mark(lookup, keys, hot).withColumn("_salt", F.explode(salts_of_key)).drop("_hot")
    salted = with_salt(fact, keys, hot, spread_by, salts)
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def left_join_many(
    cases: DataFrame, many: DataFrame, keys: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Left join of unique cases to a side that may hold any number of rows per key.

    Rows of a hot key stay in the tasks that read them and meet their one case by broadcast; there
    are at most as many such cases as the rows divided by ``hot_rows``. They are counted like any
    other side; beyond the limits both sides meet in salted parts. Where the hot keys are too many
    to be named in the plan, both sides are stored with their mark, so they are computed once.
    """
    keys = list(keys)
    hot = find_hot(many, keys, _hot_rows(hot_rows))
    if not isinstance(hot, DataFrame) and not hot:
        return cases.join(many, keys, "left")
    cases, many = with_mark(cases, keys, hot), with_mark(many, keys, hot)
    if isinstance(hot, DataFrame):
        cases, many = stored(cases), stored(many)
    few, large = (side.filter("_hot").drop("_hot") for side in (cases, many))
    plain = cases.filter("not _hot").drop("_hot").join(many.filter("not _hot").drop("_hot"), keys, "left")
    linked = lookup_join(large, few, keys, how="inner", hot_rows=hot_rows)
    alone = few.join(large.select(*keys).distinct(), keys, "left_anti")
    return plain.unionByName(linked).unionByName(alone, allowMissingColumns=True)


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    fits: bool | Size | None = None,
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    hot_source: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join a lookup on equal key names: broadcast when its counted size allows, else salted.

    ``fits`` passes on a check already made, of this side or of a table it is a part of. A ``Size``
    is booked by the budget in force, so that all broadcasts of a plan together stay within it.
    ``spread_by`` names the columns that tell rows of one hot key apart; all columns by default.
    ``hot_source``: see ``salted_left_join``.
    """
    keys = list(keys)
    if may_broadcast(size_of(lookup) if fits is None else fits):
        return fact.join(F.broadcast(lookup), keys, how)
    spread_by = list(spread_by or fact.columns)
    if how == "left":
        return salted_left_join(fact, lookup, keys, spread_by, hot_rows, hot_source=hot_source)
    if how == "left_semi":
        lookup = lookup.select(*keys).distinct()
    marked = lookup.withColumn("_found", F.lit(True))
    found = salted_left_join(fact, marked, keys, spread_by, hot_rows, hot_source=hot_source)
    return found.filter("_found").drop("_found")
