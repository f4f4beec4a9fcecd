"""Target-distribution importance resampling by hashed word runs (batch concatenation).

The texts of a batch are joined, a separator after each, and one pass of a pattern finds all words.
Runs of one to three words are hashed from the checksums of their words: the checksum of a string
and a longer one's follow from each other by a linear step that depends on the added length alone,
so no run is ever put together as text. Searching the texts' offsets tells which text a word is of;
runs that reach over a separator are masked before the buckets are counted.

Counts by bucket of all documents and of all target texts give each bucket a gain, a document's
weight is the sum of the gains of its runs, and noise drawn from its id turns the highest scores
into a sample without replacement. Ranks are counted over ranges of the scores, never in one task.

Null and empty texts have no words: no features, weight 0, never drawn. A null doc_id draws its
noise from an empty id and comes last among ties; rows that repeat a doc_id are scored one by one
and, where their scores tie, ranked in the order of weight and features. An empty table gives an
empty result, an empty target table counts as zeros. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import blocks, ship, stored, utf8

BUCKETS = 10_000
LONGEST_RUN = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: No character of a word, so that a word ends where its text does.
SEPARATOR = "\n"
BLOCK_BYTES = 1 << 20
SLICE_WORDS = 1 << 18
#: Longer words get their checksums one by one.
TABLE_LENGTH = 64
#: Relative error of the score below which no document can be drawn.
ACCURACY = 1000

SCORED = "doc_id long, n_words long, n_features long, weight long"


def _polynomial() -> np.ndarray:
    """The checksum's table of one byte, by its rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


def _steps(length: int) -> np.ndarray:
    """For 0 to ``length`` added zero bytes, four tables that move a checksum over them."""
    one = _polynomial()
    each = np.arange(256, dtype=np.uint32)
    tables = np.empty((length + 1, 4, 256), np.uint32)
    tables[0] = [each << np.uint32(8 * i) for i in range(4)]
    for n in range(1, length + 1):
        last = tables[n - 1]
        tables[n] = (last >> np.uint32(8)) ^ one[last & np.uint32(255)]
    return tables


STEPS = _steps(TABLE_LENGTH + 1)


def _moved(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved over ``length`` more bytes; at most ``TABLE_LENGTH`` + 1 each."""
    out = np.zeros(len(sums), np.uint32)
    for i in range(4):
        out ^= STEPS[length, i, (sums >> np.uint32(8 * i)) & np.uint32(255)]
    return out


class Words:
    """The words of a batch: starts, ends, text numbers, and checksums with and without a space before."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        spans = (edge for found in WORD.finditer(data) for edge in found.span())
        edges = np.fromiter(spans, np.int64).reshape(-1, 2)
        self.data = data
        self.starts, self.ends = edges[:, 0], edges[:, 1]
        self.text = np.searchsorted(offsets, self.starts, "right") - 1

    def checksums(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        words = [self.data[a:b] for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)]
        plain = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        spaced = np.fromiter((zlib.crc32(w, SPACE) for w in words), np.uint32, len(words))
        return plain, spaced

    def runs(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text numbers and checksums of all runs of words that begin between two word numbers."""
        stop = min(len(self.starts), last + LONGEST_RUN - 1)
        plain, spaced = self.checksums(first, stop)
        length = (self.ends - self.starts)[first:stop]
        text = self.text[first:stop]
        n = last - first
        sums = plain[:n]
        yield text[:n], sums
        for more in range(1, LONGEST_RUN):
            n = min(n, stop - first - more)
            if n <= 0:
                return
            sums = self._longer(sums[:n], first, more, length[more : more + n], spaced[more : more + n])
            whole = text[:n] == text[more : more + n]
            yield text[:n][whole], sums[whole]

    def _longer(self, sums, first: int, more: int, length: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """Checksums of runs one word longer: moved over the space and the word, and joined to theirs."""
        short = length <= TABLE_LENGTH
        out = _moved(sums, np.where(short, length, 0) + 1) ^ spaced
        for i in np.flatnonzero(~short):
            word = first + more + i
            out[i] = zlib.crc32(b" " + self.data[self.starts[word] : self.ends[word]], int(sums[i]))
        return out


SPACE = zlib.crc32(b" ")


def _batch_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The words of a column of texts, in blocks of rows: first and last row, and their words."""
    column = pc.ascii_lower(column.cast(pa.large_string()).fill_null(""))
    joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(SEPARATOR, pa.large_string()))
    data, offsets = utf8(joined)
    for first, last in blocks(offsets, BLOCK_BYTES):
        part = data[offsets[first] : offsets[last]].tobytes()
        yield first, last, Words(part, offsets[first : last + 1] - offsets[first])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How many runs of words of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words in _batch_words(batch.column("text")):
                for at in range(0, len(words.starts), SLICE_WORDS):
                    for _, sums in words.runs(at, min(at + SLICE_WORDS, len(words.starts))):
                        counts += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])

    ship(texts.sparkSession)
    parts = texts.select("text").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths. What comes back is two numbers a bucket, whatever the data."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, texts in ((s, documents), (t, target)):
        for row in bucket_counts(texts, buckets).collect():
            counts[row["bucket"]] = row["n"]
    above = (t + 1.0) * float(s.sum() + buckets)
    below = (s + 1.0) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Each document's words, features and sum of gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = np.zeros((3, len(batch)), np.int64)
            for first, _, words in _batch_words(batch.column("text")):
                own = words.text + first
                n_words += np.bincount(own, minlength=len(batch))
                for at in range(0, len(words.starts), SLICE_WORDS):
                    for text, sums in words.runs(at, min(at + SLICE_WORDS, len(words.starts))):
                        n_features += np.bincount(text + first, minlength=len(batch))
                        np.add.at(weight, text + first, gain[sums % np.uint32(len(gain))])
            columns = [batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def ranked(rows: DataFrame, order: list, count: int) -> DataFrame:
    """Rows with their ``rank`` by ``order``, null beyond ``count``.

    Rows are dealt to ranges of the order and sorted there, equal ones by a drawn number so that
    many of them still make several ranges; a row's place is its place in its range and the rows of
    the ranges before, of which there are as many as partitions.
    """
    order = [*order, F.asc("_tie")]
    ordered = rows.withColumn("_tie", F.rand(SEED)).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    placed = stored(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n")).collect()
    before, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        before[row["_part"]] = total
        total += row["n"]
    starts = rows.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    here = placed.withColumn("_part", F.shiftright("_place", 33).cast("int"))
    place = F.col("_before") + F.expr("_place & ((1L << 33) - 1)") + 1
    numbered = here.join(F.broadcast(starts), "_part").withColumn("_rank", place)
    return numbered.withColumn("rank", F.when(F.col("_rank") <= count, F.col("_rank"))).drop("_place", "_part", "_before", "_rank")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """Every document's features, weight, score, and its rank if it is drawn."""
    weighed = weights(docs, gains(docs, target))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(-1000 * F.log(-F.log(share))).cast("long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= min_words)
    at = 1 - percent / 100 - 2 / ACCURACY
    seen = able.agg(F.count("*").alias("n"), F.percentile_approx("score", max(at, 0.0), ACCURACY * 10).alias("low")).first()
    count = percent * seen["n"] // 100
    low = seen["low"] if count else None
    if count and able.filter(F.col("score") >= low).count() < count:
        low = able.agg(F.min("score")).first()[0]
    near = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(low)) if count else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    drawn = ranked(scored.filter(near), order, count)
    rest = scored.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
