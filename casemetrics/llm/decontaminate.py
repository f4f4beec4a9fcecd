"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are lower-cased words. The CGK embedding walks through a text and, step by step, writes down
the word it stands on and moves on or stays by a random bit of step and word. Two texts that differ
by few edits walk alike again soon after each edit, so edit distance becomes Hamming distance. From
every word of a document walks an item-sized window; the words written at a few sampled steps are its
keys in several hash tables. An item enters with walks from its start and from some later words, and
only with steps that stay inside it. Walks find most windows but not all, so every item enters by
shared blocks as well: cut into one stretch more than the edits it may have, one stretch stands
unchanged in every window that matches, so no match is missed. Where keys meet, windows that hold too
few of the item's words are left out and the others compared by exact edit distance with free ends.

A document is contaminated by an item if some window of it is within ``MAX_EDITS`` of the item's
words (a similarity of 0.8), rounded down, so items under five words must occur unchanged.

Items are the stated queries: they are taken in blocks of bounded size, and every document meets
every item. Null or empty texts, of items or documents, match nothing. Repeated rows are judged
alike, repeated items each; rows without an id too. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemetrics.llm.common import blocks, ship, utf8
from casemetrics.llm.text import mix, words

MAX_EDITS = 0.2
WALKS = 2
TABLES = 2
SAMPLES = 4
STEPS = 16
BEGINS = 5
ITEMS_PER_BLOCK = 2048
BLOCK_BYTES = 1 << 20
#: Words of a shared block that its key reads, at most.
SHARED_WORDS = 8
#: Candidates, and words of their windows, that are looked at together.
CANDIDATES = 1 << 18
WINDOW_WORDS = 1 << 20
_LEAKS = "array<struct<item_id:long,start:int,edits:int>>"


def _bits(walk: int, step: int) -> np.uint32:
    return np.uint32(int(mix(np.array([walk * 4096 + step + 1], np.uint64))[0] >> np.uint64(32)) | 1)


def _tables(size: int) -> list[tuple[int, int, np.ndarray]]:
    """(walk, table, sampled steps) for windows that walk ``size`` steps, one step of each stretch."""
    random = np.random.default_rng(size)
    n = min(SAMPLES, size)
    edges = np.linspace(0, size, n + 1).astype(int)
    return [
        (w, t, np.array([random.integers(a, b) for a, b in zip(edges, edges[1:], strict=False)]))
        for w in range(WALKS)
        for t in range(TABLES)
    ]


def walk_keys(hashes: np.ndarray, starts: np.ndarray, sizes: list[int]) -> dict[tuple[int, int, int], np.ndarray]:
    """Keys of the walks from each start, by (steps, walk, table); past the end stands no word."""
    padded = np.append(hashes, np.zeros(STEPS + 1, np.uint64))
    short = (padded >> np.uint64(32)).astype(np.uint32)
    keys = {(s, w, t): np.full(len(starts), np.uint64(s * 64 + w * 8 + t)) for s in sizes for w, t, _ in _tables(s)}
    wanted: dict[tuple[int, int], list] = {}
    for s in sizes:
        for w, t, steps in _tables(s):
            for step in steps:
                wanted.setdefault((w, int(step)), []).append((s, w, t))
    for walk in range(WALKS):
        at = starts.astype(np.int32)
        last = max((step for w, step in wanted if w == walk), default=-1)
        for step in range(last + 1):
            if (walk, step) in wanted:
                word = padded[at]
                for key in wanted[walk, step]:
                    keys[key] = (keys[key] ^ word) * np.uint64(0x9E3779B97F4A7C15)
            at += ((short * _bits(walk, step)) >> np.uint32(31)).view(np.int32)[at]
    return keys


def block_keys(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, keys of that many words in a row from every place that has so many."""
    total, done = np.zeros(len(hashes), np.uint64), 0
    for size in sorted(sizes):
        if size > len(hashes):
            return
        for i in range(done, size):
            total = total[: len(hashes) - i] + hashes[i:] * (mix(np.array([i + 1], np.uint64)) | np.uint64(1))
        done = size
        yield size, mix(total)


def _member(number: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Items:
    """One block of items with their keys."""

    def __init__(self, rows: list[tuple[int, str]], max_edits: float = MAX_EDITS):
        self.ids = [i for i, _ in rows]
        raw = [(t or "").encode() for _, t in rows]
        offsets = np.cumsum([0, *map(len, raw)])
        _, _, hashes, text = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        first = np.searchsorted(text, np.arange(len(rows) + 1))
        self.words = [hashes[a:b] for a, b in zip(first, first[1:])]
        found: dict[tuple[int, int, int], list] = {}
        for number, own in enumerate(self.words):
            for begin in sorted({len(own) * i // BEGINS for i in range(BEGINS)}):
                left = len(own) - begin
                if left < 1 or (begin and left < STEPS):
                    continue
                size = min(STEPS, 1 << (left.bit_length() - 1))
                for key, value in walk_keys(own, np.array([begin]), [size]).items():
                    found.setdefault(key, []).append((int(value[0]), number, begin))
        self.sizes = sorted({s for s, _, _ in found})
        self.keys = {key: _listed(entries) for key, entries in found.items()}
        self.length = np.array([len(own) for own in self.words], np.int64)
        self.allowed = np.array([int(len(own) * max_edits) for own in self.words], np.int64)
        shared: dict[int, list] = {}
        for number, own in enumerate(self.words):
            parts = min(int(self.allowed[number]) + 1, len(own))
            for part in range(parts):
                begin, end = len(own) * part // parts, len(own) * (part + 1) // parts
                size = min(end - begin, SHARED_WORDS)
                for _, value in block_keys(own[begin : begin + size], [size]):
                    shared.setdefault(size, []).append((int(value[0]), number, begin))
        self.shared = {size: _listed(entries) for size, entries in shared.items()}
        owner = np.repeat(np.arange(len(rows)), self.length)
        self.members = np.unique(_member(owner, hashes))


def _listed(entries: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which first 16 bits of keys occur, the sorted keys, and (item, word) of each."""
    entries.sort()
    values = np.array([e[0] for e in entries], np.uint64)
    seen = np.zeros(1 << 16, bool)
    seen[values >> np.uint64(48)] = True
    return seen, values, np.array([e[1:] for e in entries], np.int64)


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest word edits that turn the item into a stretch of the text, and that stretch's end."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    ramp = np.arange(n + 1)
    for i, word in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (text != word), out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def _met(keys: np.ndarray, listed: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, items and their first words where a key of a text is one of an item, part by part."""
    seen, wanted, entries = listed
    near = np.flatnonzero(seen[keys >> np.uint64(48)])
    low, high = (np.searchsorted(wanted, keys[near], side) for side in ("left", "right"))
    near, low, count = near[high > low], low[high > low], (high - low)[high > low]
    upto = np.cumsum(count)
    first = 0
    while first < len(near):
        before = upto[first] - count[first]
        last = max(first + 1, int(np.searchsorted(upto, before + CANDIDATES, "right")))
        n = count[first:last]
        entry = np.arange(n.sum()) + np.repeat(low[first:last] - (upto[first:last] - n - before), n)
        place = np.repeat(near[first:last], n)
        yield place, entries[entry, 0], place - entries[entry, 1]
        first = last


def _candidates(items: Items, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for size, keys in block_keys(hashes, list(items.shared)):
        yield from _met(keys, items.shared[size])
    for key, keys in walk_keys(hashes, np.arange(len(hashes)), items.sizes).items():
        if key in items.keys:
            yield from _met(keys, items.keys[key])


def _held(items: Items, hashes: np.ndarray, number: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the windows hold as many words of their items as a match leaves unchanged."""
    need = (items.length - items.allowed)[number]
    out = np.zeros(len(number), bool)
    wide = np.flatnonzero(end - begin >= need)
    upto = np.cumsum((end - begin)[wide])
    first = 0
    while first < len(wide):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + WINDOW_WORDS, "right")))
        own = wide[first:last]
        width = (end - begin)[own]
        edges = np.cumsum(width) - width
        place = np.arange(width.sum()) + np.repeat(begin[own] - edges, width)
        value = _member(np.repeat(number[own], width), hashes[place])
        at = np.minimum(np.searchsorted(items.members, value), len(items.members) - 1)
        out[own] = np.add.reduceat((items.members[at] == value).astype(np.int64), edges) >= need[own]
        first = last
    return out


def _matches(items: Items, hashes: np.ndarray, text: np.ndarray, n_texts: int) -> dict:
    """Verified (item, first word, edits) by text."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    first = np.searchsorted(text, np.arange(n_texts + 1))
    for place, number, start in _candidates(items, hashes):
        order = np.lexsort((start, number, text[place]))
        t, number, start = text[place][order], number[order], start[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (number[1:] != number[:-1]) | (start[1:] != start[:-1])
        t, number, start = t[new], number[new], start[new]
        allowed = items.allowed[number]
        begin = np.maximum(first[t], start - allowed)
        end = np.minimum(first[t + 1], start + items.length[number] + allowed)
        for i in np.flatnonzero(_held(items, hashes, number, begin, end)):
            own, candidate = (int(t[i]), int(number[i])), (int(t[i]), int(number[i]), int(start[i]))
            if candidate in tried or found.get(own, (1,))[0] == 0:
                continue
            tried.add(candidate)
            item = items.words[own[1]]
            distance, stop = edits(item, hashes[begin[i] : end[i]])
            if distance <= allowed[i]:
                at = int(max(begin[i] + stop - len(item), first[own[0]]) - first[own[0]])
                found[own] = min(found.get(own, (distance, at)), (distance, at))
    leaks: dict[int, list] = {}
    for (t, number), (distance, at) in sorted(found.items()):
        leaks.setdefault(t, []).append({"item_id": items.ids[number], "start": at, "edits": distance})
    return leaks


def _marked(docs: DataFrame, items: Items) -> DataFrame:
    names = docs.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            before = batch.column("_leaks").to_pylist()
            for first, last in blocks(offsets, BLOCK_BYTES):
                own = offsets[first : last + 1] - offsets[first]
                _, _, hashes, text = words(data[offsets[first] : offsets[last]], own)
                for t, leaks in _matches(items, hashes, text, last - first).items():
                    before[first + t] = before[first + t] + leaks
            columns = [pa.array(before, kind) if n == "_leaks" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS_PER_BLOCK:
            yield block
            block = []
    if block:
        yield block


def mark(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """All rows and columns with ``_leaks``: item, first word of the window and edits of each match."""
    ship(docs.sparkSession)
    docs = docs.drop("_leaks").withColumn("_leaks", F.array().cast(T._parse_datatype_string(_LEAKS)))
    for block in _item_blocks(items):
        docs = _marked(docs, Items(block, max_edits))
    return docs


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """One row per contaminated document and item."""
    marked = mark(docs.select(F.col("doc_id").cast("long"), "text"), items, max_edits)
    return marked.select("doc_id", F.explode("_leaks").alias("x")).select("doc_id", "x.*")
