"""A Bloom filter of keys inside a plan: rows of other keys go before they are grouped.

Spark filters at run time below joins, but not below an aggregation. Here the filter is one row with
one array of 64-bit words, computed by the query itself as a scalar subquery: no action is run while
the plan is built. Each key sets four bits of one word. The array is sized by the counted keys, as a
power of two, up to a bound; with too many keys for the bound it stays empty and lets all rows pass.
A row that passes by chance costs work, never a result: the join with the cases drops it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the largest filter, 8 MB; it serves some four million keys well.
KEY_FILTER_WORDS = 1 << 20
#: Bits a key when there is room, and the fewest with which the filter is still worth its work.
BITS_PER_KEY = 16
FEWEST_BITS = 4


def _word_bits(key: str) -> str:
    """The four bits that a key sets in its word."""
    bits = [f"shiftleft(1L, cast(shiftright(xxhash64({key}, 64), {s}) & 63 as int))" for s in (0, 6, 12, 18)]
    return " | ".join(bits)


def key_filter(keys: DataFrame, key: str, most_words: int = KEY_FILTER_WORDS) -> DataFrame:
    """One row: the words of the filter of all keys, an empty array if they are too many."""
    known = keys.select(key).filter(F.col(key).isNotNull())
    room = F.expr(f"cast(pow(2, ceil(log2(greatest(n, 4) * {BITS_PER_KEY} / 64))) as bigint)")
    enough = F.col("n") * FEWEST_BITS <= most_words * 64
    words = F.when(enough, F.least(room, F.lit(most_words).cast("long"))).otherwise(0)
    size = known.agg(F.count("*").alias("n")).select(words.alias("words"))
    masks = known.filter(size.scalar() > 0).select(
        F.pmod(F.xxhash64(key), F.nullif(size.scalar(), F.lit(0))).alias("word"), F.expr(_word_bits(key)).alias("bits")
    )
    every = size.filter("words > 0").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1)).alias("word"), F.lit(0).cast("long").alias("bits")
    )
    filled = masks.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return filled.agg(F.transform(in_order, lambda w: w["bits"]).alias("words"))


def may_hold(words: Column, key: str) -> Column:
    """Whether the filter may hold a key: true for each key of it, and rarely for others."""
    size = F.size(words)
    own = F.expr(_word_bits(key))
    place = F.pmod(F.xxhash64(key), F.nullif(size, F.lit(0)).cast("long")).cast("int")
    return (size == 0) | (F.get(words, place).bitwiseAND(own) == own)


def of_keys(rows: DataFrame, key: str, keys: DataFrame, most_words: int = KEY_FILTER_WORDS) -> DataFrame:
    """The rows whose key may be one of ``keys``, a frame with that column; all rows at a bound of 0."""
    if most_words <= 0:
        return rows
    return rows.filter(may_hold(key_filter(keys, key, most_words).scalar(), key))
