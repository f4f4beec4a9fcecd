"""What the operators share: stored intermediates, row keys, reading Arrow texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of rows that pass to a Python worker at once, whatever the length of the texts.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Prepare a session for Python workers: batches are bounded by bytes, not by rows alone, and
    those of a local session can import this package from any working folder."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, paths]))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may fall back to its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casemetrics-llm-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Later reads cost a scan of narrow columns, and a lost executor costs no recomputation.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows with a unique ``_key`` that orders them by ``doc_id``.

    Where every doc_id is present once, the key is the doc_id. Otherwise rows without a doc_id come
    last, rows that share one are ordered by their text, and a stored copy keeps the numbering the
    same for every reader.
    """
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    kept = docs.select("doc_id", "text", *columns)
    if ids["n"] == ids["d"]:
        return kept.withColumn("_key", F.col("doc_id").cast("long")).filter("_key is not null")
    order = [F.asc_nulls_last("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)]
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("_key", F.monotonically_increasing_id())
    return stored(numbered).filter("_key is not null")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and the offsets between them; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold at most ``limit`` bytes, or a single longer one."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
