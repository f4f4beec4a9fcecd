"""Reading the input tables and publishing results."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casemetrics.operators.sizing import AS_OF_BUILD, Size, sizes
from casemetrics.sources.schemas import SCHEMAS

MAPPINGS = ["groups", "root_causes", "cti_process", "cti_slas", "default_hubs", "transactions"]


@dataclass(frozen=True)
class CaseTables:
    """The ten inputs, each with the columns and types of ``schemas.SCHEMAS``."""

    tickets: DataFrame
    audit: DataFrame
    headcount: DataFrame
    concerned: DataFrame
    groups: DataFrame
    root_causes: DataFrame
    cti_process: DataFrame
    cti_slas: DataFrame
    default_hubs: DataFrame
    transactions: DataFrame

    @cached_property
    def fits(self) -> dict[str, Size]:
        """For each mapping table its counted size, true where it allows a broadcast; one job."""
        return sizes({name: getattr(self, name) for name in MAPPINGS})

    @classmethod
    def of(cls, **frames: DataFrame) -> CaseTables:
        return cls(**{name: conform(df, name) for name, df in frames.items()})


def conform(df: DataFrame, role: str) -> DataFrame:
    """Select the role's columns in its types.

    The audit event type arrives as text in some extracts and as a number in others; it becomes
    an int here, once, and text that is no number becomes null. Every other column is cast strictly:
    a value that cannot be read, such as a date, is an error and no silent null.
    """
    present = {field.name.lower(): field for field in df.schema.fields}
    missing = [f.name for f in SCHEMAS[role].fields if f.name not in present]
    if missing:
        raise ValueError(f"table {role!r} lacks columns {missing}")
    columns = []
    for field in SCHEMAS[role].fields:
        if present[field.name].dataType == field.dataType:
            columns.append(F.col(field.name))
        elif (role, field.name) == ("audit", "type"):
            columns.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def read_tables(spark: SparkSession, locations: Mapping[str, str], fmt: str = "parquet") -> CaseTables:
    """Read every role from a path (a location with a slash) or a catalogue table (without)."""
    frames = {}
    for role in SCHEMAS:
        place = locations[role]
        df = spark.read.format(fmt).load(place) if "/" in place else spark.table(place)
        frames[role] = df
    return CaseTables.of(**frames)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a session view over the plan, which reads its tables anew each time.

    A frame with parts that were stored while it was built (the two case views among them) would
    stay as of then, and is refused: publish it with ``publish_table``, or its function with
    ``live_view``.
    """
    if any(field.metadata.get(AS_OF_BUILD) for field in df.schema.fields):
        raise ValueError(f"{name}: parts of this frame are as of its build; use publish_table or live_view")
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


@dataclass(frozen=True)
class LiveView:
    """A named view that is planned on every read: sizes are counted and parts stored again, so
    the rows are those that its tables hold at that time."""

    name: str
    build: Callable[[], DataFrame]

    def read(self) -> DataFrame:
        """The frame as of now; the session view of that name follows it."""
        df = self.build()
        df.createOrReplaceTempView(self.name)
        return df


def live_view(name: str, build: Callable[[], DataFrame]) -> LiveView:
    """Publish a function that reads its tables and plans a frame over them; no work is done yet."""
    return LiveView(name, build)


def publish_table(
    df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Write the result and return a frame that reads it back."""
    writer = _without_marks(df).write.mode("overwrite").format(fmt)
    reader = df.sparkSession.read.format(fmt)
    if partition_by:
        writer, reader = writer.partitionBy(partition_by), reader.schema(_table_schema(df, partition_by))
    writer.save(path)
    return reader.load(path)


def publish_changes(df: DataFrame, path: str, partition_by: str, fmt: str = "parquet") -> DataFrame:
    """Bring a published table to the rows of the frame by writing only the partitions that differ.

    Each partition of the frame and of the table is reduced to its number of rows and the sum of
    their hashes, map-side, so the two meet as one row a partition. Partitions that differ are
    computed once more, with their values as a filter that reaches the scans, and replaced; those
    without rows any more are removed. A month's percentiles stand in all its cases, so a changed
    case can change several days: what is compared is the result. A null partition value is one
    partition. Without a table, or with one of other columns, all is written. A run that breaks off is
    mended by the next one.
    """
    spark, df = df.sparkSession, _without_marks(df)
    schema = _table_schema(df, partition_by)
    try:
        present = spark.read.format(fmt).load(path).columns
    except AnalysisException:  # no table, or one that never had a row
        present = None
    if present != schema.names:
        return publish_table(df, path, partition_by, fmt)
    kept = spark.read.format(fmt).schema(schema).load(path)
    now = _digests(df, partition_by, schema.names).alias("now")
    before = _digests(kept.withColumn("_file", F.input_file_name()), partition_by, schema.names, F.min("_file").alias("file"))
    before = before.alias("before")
    same_day = F.col("now.day").eqNullSafe(F.col("before.day"))
    differ = F.col("now.n").isNull() | F.col("before.n").isNull() | (F.col("now.n") != F.col("before.n"))
    changed = now.join(before, same_day, "full").filter(differ | (F.col("now.h") != F.col("before.h")))
    days = changed.select("now.day", F.col("now.n").isNotNull().alias("present"), "before.file").collect()
    written = [r.day for r in days if r.present]
    if written:
        rows = F.col(partition_by).isin([d for d in written if d is not None])
        if None in written:
            rows = F.coalesce(rows, F.lit(False)) | F.col(partition_by).isNull()
        writer = df.filter(rows).write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(partition_by).save(path)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in days:
        if not row.present:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row.file)).getParent()
            folder.getFileSystem(hadoop).delete(folder, True)
    return spark.read.format(fmt).schema(schema).load(path)


def _table_schema(df: DataFrame, partition_by: str) -> StructType:
    """The columns of a partitioned table, which ends with the column it is partitioned by."""
    names = [c for c in df.columns if c != partition_by]
    return _without_marks(df).select(*names, partition_by).schema


def _without_marks(df: DataFrame) -> DataFrame:
    for field in df.schema.fields:
        if field.metadata.get(AS_OF_BUILD):
            df = df.withMetadata(field.name, {})
    return df


def _digests(df: DataFrame, day: str, columns: list[str], *more: Column) -> DataFrame:
    """Per partition value its number of rows and the sum of their hashes; nulls count by column."""
    values = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    hashed = F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("h")
    return df.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"), hashed, *more)
