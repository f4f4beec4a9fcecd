"""Best-fit packing of tokenised documents into sequences (best-two-fit).

Documents are tokenised, ended by one end token, cut into pieces only where they are longer than a
sequence, and packed. Packing sees lengths alone: pieces are dealt by hash to shards of some tens of
thousands, and each shard is packed as counts by length, so its work depends on the sequence length
and not on the number of pieces. A shard leaves at most a few sequences unfilled.

Null and empty texts are documents of the end token alone. Rows that repeat a doc_id, or have none,
are packed one by one; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import blocks, ship, stored, utf8
from casemetrics.llm.text import IS_SPACE, prefix_sums, span_hashes

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 65_536
CACHED_WORDS = 1_000_000
BLOCK_BYTES = 1 << 20
#: Words that the library encodes at once; what it returns takes some hundred times their bytes.
LEARNED_AT_ONCE = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokens:
    """Token ids of texts, each distinct word tokenised once.

    The vocabulary never merges across white space, nor a letter with a full stop or comma that
    ends its word, so a text's ids are those of its parts in a row. Strings of special tokens are
    read as these tokens, as the library does by default; they hold no white space. The parts met
    are kept, up to a bound, beyond which the store starts anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def learn(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.known) + len(hashes) > CACHED_WORDS:
            self.clear()
        lengths, flats = [], []
        for k in range(0, len(hashes), LEARNED_AT_ONCE):
            spans = zip(starts[k : k + LEARNED_AT_ONCE].tolist(), ends[k : k + LEARNED_AT_ONCE].tolist(), strict=True)
            found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in spans], add_special_tokens=False)
            ids = [x.ids for x in found]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
        length, flat = np.concatenate(lengths), np.concatenate(flats)
        first = len(self.ids) + np.cumsum(length) - length
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")  # two sorted runs, which are merged
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the offsets between them."""
        starts, ends = _parts(data, offsets)
        hashes = span_hashes(prefix_sums(data), starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        missing = self._missing(distinct)
        if missing.any():
            if len(self.known) + missing.sum() > CACHED_WORDS:
                self.clear()
                missing[:] = True
            at = where[missing]
            self.learn(distinct[missing], data.tobytes(), starts[at], ends[at])
        place = np.searchsorted(self.known, distinct)[inverse]
        length, first = self.length[place], self.first[place]
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(before[-1]) + np.repeat(first - before[:-1], length)]
        return ids, before[np.searchsorted(starts, offsets)]

    def _missing(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(distinct), bool)
        at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
        return self.known[at] != distinct


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space, without a single final full stop or comma, which stands alone."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = IS_SPACE[data]
    filled = np.diff(offsets) > 0
    begins = ~space[1:-1] & space[:-2]
    begins[offsets[:-1][filled]] = ~space[1:-1][offsets[:-1][filled]]
    finishes = ~space[1:-1] & space[2:]
    finishes[offsets[1:][filled] - 1] = ~space[1:-1][offsets[1:][filled] - 1]
    lowered = data | 0x20
    after_letter = np.zeros(len(data), bool)
    after_letter[1:] = (lowered[:-1] >= 97) & (lowered[:-1] <= 122)
    mark = finishes & ~begins & after_letter & ((data == 0x2E) | (data == 0x2C))
    begins |= mark
    finishes[np.flatnonzero(mark) - 1] = True
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


_TOKENS: dict[str, WordTokens] = {}


def _word_tokens(path: str) -> WordTokens:
    """One store per worker process, used by all tasks that it runs."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its document, number, start, length and checksum of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer_path)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in blocks(offsets, BLOCK_BYTES):
                part = data[offsets[first] : offsets[last]]
                ids, at = tokens.encode(part, offsets[first : last + 1] - offsets[first])
                rows = []
                for i in range(last - first):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        rows.append((first + i, piece, start, len(cut), zlib.crc32(cut)))
                owner, *rest = map(np.array, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(owner)),
                        *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), *[pa.int64()] * 3), strict=True)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    ship(docs.sparkSession, BLOCK_BYTES)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_two_fit(counts: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Contents of sequences as (how many alike, lengths), from ``counts[length]``.

    A sequence is filled greedily with the longest piece that still fits. Then, where a gap is
    left, its smallest piece gives way to the two unpacked pieces that fill the expanded gap best.
    Equal sequences are made together, as many as the counts allow.
    """
    capacity = len(counts) - 1
    counts = counts.copy()
    while counts.any():
        present = np.flatnonzero(counts)
        taken = np.zeros(capacity + 1, np.int64)
        lengths: list[int] = []
        gap = capacity
        while gap:
            fits = present[(present <= gap) & (counts[present] > taken[present])]
            if not len(fits):
                break
            lengths.append(int(fits[-1]))
            taken[fits[-1]] += 1
            gap -= int(fits[-1])
        if gap and len(lengths) > 1:
            small = lengths[-1]
            pair = _best_pair(counts - taken, small + gap)
            if pair and sum(pair) > small:
                lengths[-1:] = pair
                taken[small] -= 1
                for x in pair:
                    taken[x] += 1
        used = np.flatnonzero(taken)
        times = int((counts[used] // taken[used]).min())
        counts[used] -= times * taken[used]
        yield times, lengths


def _best_pair(free: np.ndarray, room: int) -> list[int] | None:
    """The two lengths of the largest sum within ``room``; the more even pair among equals."""
    lengths = np.flatnonzero(free[: room + 1] > 0)
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, room - lengths, "right") - 1
    partner = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    twice = (partner == lengths) & (free[lengths] < 2)
    partner = np.where(twice, np.where(at >= 1, lengths[np.maximum(at - 1, 0)], 0), partner)
    total = np.where(partner > 0, lengths + partner, 0)
    best = total.max()
    if best == 0:
        return None
    i = np.flatnonzero(total == best)[-1]
    return sorted((int(lengths[i]), int(partner[i])), reverse=True)


def _pack_shard(capacity: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Give every piece of one shard its sequence and place."""
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
    length = rows["length"].to_numpy()
    counts = np.bincount(length, minlength=capacity + 1)
    next_row = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    made = 0
    for times, lengths in best_two_fit(counts):
        place = 0
        for x in lengths:
            at = slice(next_row[x], next_row[x] + times)
            sequence[at] = made + np.arange(times)
            offset[at] = place
            next_row[x] += times
            place += x
        made += times
    shard = int(rows["_shard"].iloc[0])
    return rows.drop(columns="_shard").assign(sequence_id=(shard << 32) + sequence, offset=offset)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """One row per piece with its sequence and place; sequences fill from 0 without gaps."""
    pieces = stored(token_pieces(docs, tokenizer_path, capacity))
    shards = max(1, -(-pieces.count() // shard_pieces))
    spread = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("_shard", F.pmod(spread, F.lit(shards)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(capacity, rows)

    return dealt.groupBy("_shard").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
