"""Near-duplicate documents by SuperMinHash, banding, verification and component grouping.

A document is the set of its distinct shingles of five lower-cased words; one with fewer words is a
single shingle, one without words is empty and linked with nothing. Two documents are linked where
the exact similarity of their sets reaches the threshold, and grouped with all they reach.

Texts with equal sets are one class, found by a hash of the whole set, so copies meet once. Classes
that share a band of their signatures are compared with the most central member of that bucket, the
one that meets most others over all its bands, never all with all: copies of one original are nearer
to it, or to the copy least changed, than to each other. Where a bucket then still holds several components, its members are dealt anew by the
rare shingles of which two linked sets must share one: with shingles ordered from rare to frequent,
sets of n that share 85 % agree in one of their first n - 0.85 n + 1. There they are compared with
more and more leaders, until every pair of different components is decided; a parity sketch of the
sets bounds their difference from below and settles most pairs before the sets meet. No bucket, link or
component passes through one task or the driver.

A null text is empty. Rows that repeat a doc_id stay separate documents; a row without one comes
last. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemetrics.llm.common import blocks, keyed, ship, stored, utf8
from casemetrics.llm.components import components
from casemetrics.llm.text import mix, shingles, words
from casemetrics.operators.sizing import fits_broadcast

BANDS = 25
BAND_ROWS = 5
SHINGLE_WORDS = 5
MIN_PERCENT = 85
BLOCK_BYTES = 1 << 20
#: Bytes of rows that pass to a Python worker at once; no more than a block, which it works on as one.
BATCH_BYTES = BLOCK_BYTES
MORE_LEADERS = 16
#: Members of a group that meet its leaders in one task; larger groups are dealt to several.
PART_ROWS = 512
PARITY_WORDS = 32


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, size: int) -> np.ndarray:
    """SuperMinHash signatures of many sets of 64-bit elements; rows of empty sets are infinite.

    Every element walks through its own random permutation of the components, one component a
    level, and offers there its level plus a uniform fraction; a component keeps the smallest
    offer. A set whose components all hold offers below the next level is finished and its elements
    drop out, which is the early stop: long sets end after a level or two.
    """
    signature = np.full(n_sets * size, np.inf)
    steps: list[np.ndarray] = []
    moved: list[np.ndarray] = []

    def value_at(position: np.ndarray) -> np.ndarray:
        """What the permutation holds at a position not yet used, after the swaps so far."""
        value = position.copy()
        for to, what in zip(steps, moved, strict=True):
            np.copyto(value, what, where=to == position)
        return value

    for level in range(size):
        if not len(elements):
            break
        random = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
        fraction = (random >> np.uint64(24)).astype(np.float64) * 2.0**-40
        pick = level + ((random & np.uint64(0xFFFFFF)) * np.uint64(size - level) >> np.uint64(24)).astype(np.int32)
        component = value_at(pick)
        moved.append(value_at(np.full(len(pick), level, np.int32)))
        steps.append(pick)
        np.minimum.at(signature, owner * size + component, level + fraction)
        largest = signature.reshape(n_sets, size).max(axis=1)
        stay = largest[owner] >= level + 1
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
            steps, moved = [x[stay] for x in steps], [x[stay] for x in moved]
    return signature.reshape(n_sets, size)


def _text_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, text = words(data, offsets)
    return shingles(hashes, text, len(offsets) - 1, size)


def _digest(made: np.ndarray, owner: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each whole set."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner, mix(made ^ np.uint64(seed)))
    return mix(total + np.uint64(seed)).view(np.int64)


def signatures(docs: DataFrame, bands: int, band_rows: int, shingle_words: int) -> DataFrame:
    """Per document its number of shingles, a hash of the set in two parts, and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, band_rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in blocks(offsets, BLOCK_BYTES):
                own = offsets[first : last + 1] - offsets[first]
                made, owner = _text_shingles(data[offsets[first] : offsets[last]], own, shingle_words)
                n = last - first
                count = np.bincount(owner, minlength=n)
                rows = super_minhash(made, owner, n, bands * band_rows)
                cells = rows.reshape(n, bands, band_rows).view(np.uint64)
                hashed = mix((mix(cells) * salt).sum(axis=2, dtype=np.uint64)).view(np.int64)
                filled = np.where(count > 0, bands, 0)
                kept = hashed[count > 0].reshape(-1)
                ends = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_key").slice(first, n),
                        batch.column("doc_id").slice(first, n),
                        pa.array(count.astype(np.int64)),
                        pa.array(_digest(made, owner, n, 0x51)),
                        pa.array(_digest(made, owner, n, 0xA7)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(kept)),
                    ],
                    names=["_key", "doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    ship(docs.sparkSession, BATCH_BYTES)
    schema = "_key long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
    return docs.select("_key", F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """Per document the sorted hashes of its shingles and their parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in blocks(offsets, BLOCK_BYTES):
                own = offsets[first : last + 1] - offsets[first]
                made, owner = _text_shingles(data[offsets[first] : offsets[last]], own, shingle_words)
                ends = np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_key").slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(made.view(np.int64))),
                        _parity(made, owner, last - first),
                    ],
                    names=["_key", "shingles", "parity"],
                )

    ship(docs.sparkSession, BATCH_BYTES)
    return docs.select("_key", "text").mapInArrow(run, "_key long, shingles array<long>, parity array<long>")


def _parity(made: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Per set, for each of ``64 * PARITY_WORDS`` cells, whether an odd number of elements falls there."""
    cell = mix(made ^ np.uint64(0x9A217)) % np.uint64(64 * PARITY_WORDS)
    sketch = np.zeros(n * PARITY_WORDS, np.uint64)
    np.bitwise_xor.at(sketch, owner * PARITY_WORDS + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    ends = np.arange(n + 1, dtype=np.int32) * PARITY_WORDS
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch.view(np.int64)))


def _verified(pairs: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    left = sets.select(F.col("_key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("_key").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(right, "b").join(left, "a").withColumn("_shared", shared.cast("long"))
    union = F.size("x") + F.size("y") - F.col("_shared")
    return both.filter(F.lit(100) * F.col("_shared") >= F.lit(min_percent) * union).select("a", "b")


def _split(n: str) -> Column:
    """Into how many parts a group of so many members is dealt."""
    return F.ceil(F.col(n) / PART_ROWS).cast("int").alias("split")


def _meet(members: DataFrame, named: DataFrame) -> DataFrame:
    """Members with the rows named for their group; members are dealt to the parts of the group by
    their key, and the few named rows stand in every part."""
    own = members.withColumn("_part", F.pmod(F.hash("key"), "split"))
    every = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_split") - 1))).drop("_split")
    return own.join(every, ["group", "_part"]).drop("_part")


def _pairs(live: DataFrame, leaders: DataFrame, min_percent: int) -> DataFrame:
    """Each member with each leader of its group that lies in another component and can be near enough.

    Cells whose parities differ are no more than the elements that only one of two sets holds, so a
    pair with too many of them is not linked, whatever the elements are; no linked pair is lost.
    The first element that linked sets share, in the order of the groups, leaves enough behind it in
    both; a pair is only met in groups where that holds.
    """
    columns = ["key", "component", "size", "split", *[c for c in ("parity", "place") if c in leaders.columns]]
    named = leaders.select("group", *[F.col(c).alias(f"_{c}") for c in columns])
    both = F.col("size") + F.col("_size")
    near = F.least("size", "_size") * 100 >= F.greatest("size", "_size") * min_percent
    if "place" in columns:
        left = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) + 1
        near = near & (left * (100 + min_percent) >= both * min_percent)
    if "parity" in columns:
        unlike = F.aggregate(
            F.zip_with("parity", "_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
        )
        near = near & (unlike * (100 + min_percent) <= both * (100 - min_percent))
    met = _meet(live, named).filter((F.col("component") != F.col("_component")) & near)
    return met.select(F.greatest("key", "_key").alias("a"), F.least("key", "_key").alias("b")).distinct()


def _leaders(live: DataFrame, parts: int) -> DataFrame:
    """The most central member of each of the parts that a group is dealt to by hash."""
    part = F.pmod(F.xxhash64("key", F.lit(parts)), F.lit(parts)).alias("part")
    names = ["key", "component", "size", "split", *[c for c in ("place", "parity") if c in live.columns]]
    best = F.min(F.struct((-F.col("central")).alias("_far"), *names))
    return live.groupBy("group", part).agg(best.alias("l")).select("group", *[f"l.{c}" for c in names])


def _with_components(members: DataFrame, grouped: DataFrame) -> DataFrame:
    named = members.drop("component").join(grouped.withColumnRenamed("node", "key"), "key", "left")
    return named.withColumn("component", F.coalesce("component", "key"))


def _undecided(members: DataFrame) -> DataFrame:
    """Members of groups that hold several components."""
    ends = members.groupBy("group", F.col("split").alias("_split")).agg(
        F.min("component").alias("x"), F.max("component").alias("y")
    )
    return _meet(members, ends.filter("x <> y").select("group", "_split"))


def _rare_groups(members: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """Members by those of their rarest shingles of which linked sets share at least one."""
    some = members.select(F.col("key").alias("_key")).distinct()
    held = sets.join(some, "_key").select(F.col("_key").alias("key"), F.explode("shingles").alias("group"))
    often = held.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    alone = F.col("size") - F.count("*").over(Window.partitionBy("key"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "group")) + alone
    sizes = members.select("key", "size", "component", "central").distinct()
    sizes = sizes.join(sets.select(F.col("_key").alias("key"), "parity"), "key")
    needed = F.floor((F.col("size") * min_percent + 99) / 100)
    ranked = held.join(often.withColumn("split", _split("n")), "group").join(sizes, "key").withColumn("_rank", rank)
    return ranked.filter(F.col("_rank") <= F.col("size") - needed + 1).select(
        "group", "key", "size", "component", "central", "split", F.col("_rank").alias("place"), "parity"
    )


def near_duplicates(
    docs: DataFrame,
    min_percent: int = MIN_PERCENT,
    shingle_words: int = SHINGLE_WORDS,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id and the row's _key.

    ``component_id`` is the smallest doc_id of the group, ``class_id`` the smallest one with an
    equal set, ``kept`` marks the first row of the group. At similarity 0.85 a link is missed by
    25 bands of 5 with a probability of four in ten million.
    """
    docs = keyed(docs)
    signed = stored(signatures(docs, bands, band_rows, shingle_words))
    classes = signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("_key").alias("class"))
    one_each = signed.join(classes, F.col("_key") == F.col("class"), "left_semi")
    banded = one_each.select(
        F.col("_key").alias("key"), F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "hash")
    ).select("key", "size", F.xxhash64("band", "hash").alias("group"), F.col("key").alias("component"))
    several = banded.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    live = banded.join(several, "group")
    central = live.groupBy("key").agg(F.sum("n").alias("central"))
    live = stored(live.withColumn("split", _split("n")).drop("n").join(central, "key"))
    involved = live.select(F.col("key").alias("_key")).distinct()
    if fits_broadcast(involved):
        involved = F.broadcast(involved)
    sets = stored(shingle_sets(docs.join(involved, "_key", "left_semi"), shingle_words))
    decided = stored(_pairs(live, _leaders(live, 1), min_percent))
    grouped = components(_verified(decided, sets, min_percent))
    live = stored(_undecided(_with_components(live, grouped)))
    if not live.isEmpty():
        live, parts = stored(_undecided(_rare_groups(live, sets, min_percent))), 1
    while not live.isEmpty():
        leaders = _leaders(live, parts)
        pairs = stored(_pairs(live, leaders, min_percent).join(decided, ["a", "b"], "left_anti"))
        rest = live.join(leaders.select("group", "key"), ["group", "key"], "left_anti")
        if not pairs.isEmpty():
            decided = decided.unionByName(pairs)
            found = stored(_verified(pairs, sets, min_percent))
            if not found.isEmpty():
                stars = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
                grouped = components(stars.unionByName(found))
                rest = _with_components(rest, grouped)
        live, parts = stored(_undecided(rest)), parts * MORE_LEADERS
    return _result(signed, classes, grouped)


def _result(signed: DataFrame, classes: DataFrame, grouped: DataFrame) -> DataFrame:
    known = signed.select("_key", "doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left")
    known = known.withColumn("class", F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("_key")))
    known = known.join(grouped.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("component", F.coalesce("component", "class"))
    first = signed.select(F.col("_key").alias("component"), F.col("doc_id").alias("component_id"))
    own = signed.select(F.col("_key").alias("class"), F.col("doc_id").alias("class_id"))
    return (
        known.join(first, "component")
        .join(own, "class")
        .select(
            "doc_id", "n_shingles", "component_id", (F.col("_key") == F.col("component")).alias("kept"), "class_id", "_key"
        )
    )
