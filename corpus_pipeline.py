"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, personal data, packing.

``STAGES`` are (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a
frame that is written and read again as the next one's documents; all but the last return the
columns of documents. Null and repeated rows are treated as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemetrics.llm import decontaminate, near_dedup, packing, pii, quality
from casemetrics.llm.common import keyed, stored, table
from casemetrics.llm.linear import held_out, training_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels")
    model = quality.train(training_rows(docs, labels, "quality", held_out(5, 0)))
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at a similarity of 0.8."""
    rows = keyed(docs, "lang", "source", "n_chars")
    numbered = rows.select(F.col("_key").alias("doc_id"), "text")
    groups = near_dedup.near_duplicates(numbered, min_percent=80, bands=40, band_rows=5)
    gone = groups.filter("not kept and n_shingles > 0").select(F.col("doc_id").alias("_key"))
    return rows.join(gone, "_key", "left_anti").select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    marked = decontaminate.mark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("_leaks") == 0).select(*COLUMNS)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and remove the terms that disclose it; n_chars follows the text."""
    clean = pii.sanitise(docs.select(*COLUMNS))
    changed = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed.cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmarks),
    ("pii", sanitised),
    ("packing", packed),
]

#: The learned stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
