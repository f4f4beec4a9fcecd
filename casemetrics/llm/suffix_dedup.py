"""Repeated byte strings across a corpus, by depth-limited radix sort of sampled suffixes.

Two windows of ``window`` bytes are equal only if the smallest of their k-byte grams stands at the
same place in both. So suffixes are sorted from those anchors, about one in 35 bytes, instead of
from every byte. The passes go from the most significant digit down, and what is alone drops out:

1. the anchor gram: an anchor whose gram is alone lies in no repeated window;
2. the span, which is all windows that share the anchor: an anchor with an earlier equal span is
   repeated as a whole, and a gram with a single span is finished;
3. the windows themselves, for the anchors left where repeated passages begin and end: equal groups
   are exactly the repeated windows, and the first of each stays.

Hashes take the place of bytes: 64 bits a digit, where every digit is compared inside its parent's
group; windows are compared by 128 bits.

A text is its UTF-8 bytes; a null one is empty. Matches never cross texts. Rows that repeat a doc_id
are separate documents, ordered by text; rows without one come last. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import keyed, ship, stored, utf8
from casemetrics.llm.text import BASE_2, BYTE_VALUES_2, mix, prefix_sums, span_hashes

WINDOW = 100
GRAM = 32
BLOCK_BYTES = 1 << 20
TASK_BYTES = 32 << 20
#: A gram with more different spans in one task is compared by windows dealt one by one.
HOT_SPANS = 64
HOT_ROWS = 4096

_CANDIDATE, _HOT_GRAM, _HOT, _REMOVED = range(4)
_ANCHORS = "gram long, span long, key long, at long"
_REGIONS = "gram long, key long, start long, n long, kind int"


def anchors(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Runs of windows that share their smallest gram: first start, number, gram and span hashes.

    ``ends`` are the offsets of texts that lie end to end in ``data``. Among equal grams the first
    counts, so equal windows always choose the same one.
    """
    n = len(data)
    if n < window:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    grams = span_hashes(sums, at, at + gram)
    bits = np.uint64((1 << int(n).bit_length()) - 1)
    least, reach, wide = (grams & ~bits) | at.astype(np.uint64), 1, window - gram + 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if wide > reach:
        least = np.minimum(least[: reach - wide], least[wide - reach :])
    place = (least & bits).astype(np.int64)
    open_ = np.zeros(n + 1, np.int64)
    lengths = np.diff(ends)
    whole = lengths >= window
    np.add.at(open_, ends[:-1][whole], 1)
    np.add.at(open_, ends[1:][whole] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(open_)[: len(place)] > 0)
    if not len(starts):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    new = np.ones(len(starts), bool)
    new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    other = prefix_sums(data, BYTE_VALUES_2, BASE_2)
    return first, last - first + 1, grams[place[first]], span_hashes(other, first, last + window, BASE_2)


def _text_blocks(keys: np.ndarray, offsets: np.ndarray, window: int, block_bytes: int):
    """Byte ranges of up to a block with the texts in them: (begin, ends, keys, starts in text).

    A longer text is cut into blocks that overlap by one byte less than a window.
    """
    row, n = 0, len(keys)
    while row < n:
        if offsets[row + 1] - offsets[row] > block_bytes:
            begin, end = offsets[row], offsets[row + 1]
            while end - begin >= window or begin == offsets[row]:
                stop = min(end, begin + block_bytes)
                yield begin, np.array([0, stop - begin]), keys[row : row + 1], np.array([begin - offsets[row]])
                if stop == end:
                    break
                begin = stop - window + 1
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        yield offsets[row], offsets[row : last + 1] - offsets[row], keys[row:last], np.zeros(last - row, np.int64)
        row = last


def _earlier_in_task(gram, span, key, start, n):
    """Which rows repeat an earlier equal span of this task, and the number of spans of each gram."""
    order = np.lexsort((start, key, span, gram))
    g, s = gram[order], span[order]
    new_gram = np.ones(len(g), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_span = new_gram.copy()
    new_span[1:] |= s[1:] != s[:-1]
    number = np.cumsum(new_gram) - 1
    repeated, spans = np.empty(len(g), bool), np.empty(len(g), np.int64)
    repeated[order] = ~new_span
    spans[order] = np.bincount(number, weights=new_span).astype(np.int64)[number]
    return repeated, spans


def _joined(key: np.ndarray, start: np.ndarray, n: np.ndarray):
    """Runs of windows merged where one goes on where another ends."""
    order = np.lexsort((start, key))
    key, start, n = key[order], start[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return key[at], start[at], np.add.reduceat(n, at) if len(at) else n


def _anchor_rows(
    docs: DataFrame, window: int, gram: int, hot_spans: int, task_bytes: int, block_bytes: int
) -> DataFrame:
    """Rows for the first two digits, combined in each task before they are dealt out.

    A later copy of a span of the same task is repeated for certain; such windows leave as merged
    runs. ``at`` packs start, number of windows and kind.
    """

    def flushed(parts) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        g, s, key, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        repeated, spans = _earlier_in_task(g, s, key, start, n)
        hot = ~repeated & (spans > hot_spans)
        kind = np.where(hot, _HOT, _CANDIDATE)[~repeated]
        run_key, run_start, run_n = _joined(key[repeated], start[repeated], n[repeated])
        seen = np.unique(g[hot])
        columns = [
            np.concatenate([g[~repeated], seen, mix(run_key.view(np.uint64))]).view(np.int64),
            np.concatenate([s[~repeated], np.zeros(len(seen), np.uint64), mix(run_start.view(np.uint64))]).view(np.int64),
            np.concatenate([key[~repeated], np.full(len(seen), -1), run_key]),
            np.concatenate([_packed(start[~repeated], n[~repeated], kind), np.full(len(seen), _HOT_GRAM)]),
        ]
        # runs may be longer than the packed number allows, so they are cut
        pieces = -(-run_n // _MOST)
        cut = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(_MOST, np.repeat(run_n, pieces) - cut * _MOST)
        for i, x in ((0, run_key), (1, run_start), (2, run_key)):
            tail = np.repeat(columns[i][-len(run_key) :] if len(run_key) else x, pieces)
            columns[i] = np.concatenate([columns[i][: len(columns[i]) - len(run_key)], tail])
        columns[3] = np.concatenate([columns[3], _packed(np.repeat(run_start, pieces) + cut * _MOST, size, np.full(len(size), _REMOVED))])
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[i : i + 100_000]) for x in columns], names=["gram", "span", "key", "at"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            for begin, ends, own, before in _text_blocks(keys, offsets, window, block_bytes):
                first, n, g, s = anchors(data[begin : begin + ends[-1]], ends, window, gram)
                text = np.searchsorted(ends, first, "right") - 1
                parts.append((g, s, own[text], first - ends[text] + before[text], n))
                held += int(ends[-1])
                if held >= task_bytes:
                    yield from flushed(parts)
                    parts, held = [], 0
        yield from flushed(parts)

    ship(docs.sparkSession)
    return docs.select("_key", "text").mapInArrow(run, _ANCHORS)


_MOST = (1 << 16) - 1


def _packed(start, n, kind) -> np.ndarray:
    return (np.asarray(start, np.int64) << 18) | (np.asarray(n, np.int64) << 2) | np.asarray(kind, np.int64)


def _regions(hot_rows: int):
    """Decide sorted anchors by gram and span: repeated runs, and anchors to compare by windows.

    Only the rows of the group that is still open are held, and at most ``hot_rows`` of them; a
    larger group is hot, and its rows go on one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        hot_gram, last = None, None
        done = False
        while not done:
            batch = next(batches, None)
            done = batch is None
            new = [np.empty(0, np.int64)] * 4 if done else [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            gram, span, key, at = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(gram):
                continue
            tail = len(gram) if done else int(np.searchsorted(gram, gram[-1]))
            cut = len(gram) if len(gram) - tail > hot_rows else tail
            overflow = cut > tail
            held = [x[cut:] for x in (gram, span, key, at)]
            gram, span, key, at = (x[:cut] for x in (gram, span, key, at))
            if not cut:
                continue
            kind, n, start = at & 3, (at >> 2) & _MOST, at >> 18
            first_gram = np.ones(cut, bool)
            first_gram[1:] = gram[1:] != gram[:-1]
            real = kind != _HOT_GRAM
            removed = kind == _REMOVED
            before = np.maximum.accumulate(np.where(real & ~removed, np.arange(cut), -1))
            before = np.concatenate([[-1], before[:-1]])
            same = (before >= 0) & (gram[before] == gram) & (span[before] == span)
            if last is not None and gram[0] == last[0]:
                same |= (before < 0) & (gram == last[0]) & (span == last[1])
            number = np.cumsum(first_gram) - 1
            candidate = real & ~removed
            fresh = candidate & ~same
            spans = np.bincount(number, weights=fresh)
            hot = np.bincount(number, weights=~real | (kind == _HOT)) > 0
            if overflow:
                hot[number[-1]] = True
            if hot_gram is not None and gram[0] == hot_gram:
                hot[0] = True
            hot_gram = gram[-1] if hot[-1] else None
            if candidate.any():
                i = np.flatnonzero(candidate)[-1]
                last = (gram[i], span[i])
            compare = fresh & ((spans[number] > 1) | hot[number])
            out = removed | (candidate & same) | compare
            what = np.where(compare, np.where(hot[number], 2, 1), 0)[out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (gram[out], key[out], start[out], n[out])] + [pa.array(what, pa.int32())],
                names=["gram", "key", "start", "n", "kind"],
            )

    return run


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """The anchors to compare, with their bytes; those of hot grams as single windows by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            listed = batch.column("_regions")
            counts = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            if not len(flat):
                continue
            gram, start, n, kind = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.repeat(np.arange(len(keys)), counts)
            begin = offsets[row] + start
            cold = np.flatnonzero(kind == 1)
            raw = [bytes(data[a : a + m + window - 1]) for a, m in zip(begin[cold], n[cold], strict=True)]
            out = [[gram[cold]], [np.zeros(len(cold), np.int64)], [keys[row[cold]]], [start[cold]], [n[cold]], [pa.array(raw, pa.binary())]]
            hot = np.flatnonzero(kind == 2)
            if len(hot):
                pick = [data[a : a + m + window - 1] for a, m in zip(begin[hot], n[hot], strict=True)]
                h1, h2, owner, inside = _exploded(pick, n[hot], window)
                key, at = keys[row[hot]][owner], start[hot][owner] + inside
                order = np.lexsort((at, key, h2, h1))
                a, b = h1[order], h2[order]
                later = np.zeros(len(a), bool)
                later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                # a later copy in this batch is repeated; it goes on under a hash of its place
                key, at = key[order], at[order]
                a = np.where(later, mix(key.view(np.uint64) + at.view(np.uint64)).view(np.int64), a)
                run_key, run_at, run_n = _joined(key[later], at[later], np.ones(int(later.sum()), np.int64))
                keep = ~later
                out[0] += [a[keep], mix(run_key.view(np.uint64) + run_at.view(np.uint64)).view(np.int64)]
                out[1] += [b[keep], np.zeros(len(run_key), np.int64)]
                out[2] += [key[keep], run_key]
                out[3] += [at[keep], run_at]
                out[4] += [np.zeros(int(keep.sum()), np.int64), -run_n]
                out[5].append(pa.nulls(int(keep.sum()) + len(run_key), pa.binary()))
            arrays = [pa.array(np.concatenate(x)) for x in out[:5]] + [pa.concat_arrays(out[5])]
            yield pa.RecordBatch.from_arrays(arrays, names=["g1", "g2", "key", "start", "n", "bytes"])

    return docs.mapInArrow(run, "g1 long, g2 long, key long, start long, n long, bytes binary")


def _exploded(pieces: list[np.ndarray], n: np.ndarray, window: int):
    """Both hashes, owner and place of every window of byte strings that hold ``n`` windows each."""
    data = np.concatenate(pieces)
    base = np.cumsum([0, *map(len, pieces)])[:-1]
    owner = np.repeat(np.arange(len(pieces)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = base[owner] + inside
    h1 = span_hashes(prefix_sums(data), at, at + window).view(np.int64)
    h2 = span_hashes(prefix_sums(data, BYTE_VALUES_2, BASE_2), at, at + window, BASE_2).view(np.int64)
    return h1, h2, owner, inside


def _repeated_windows(window: int):
    """Decide sorted windows: every one with an earlier equal one is repeated.

    Rows without bytes are single windows of hot grams, compared with the row before, or runs that
    are decided already (negative numbers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last = None
        for batch in _with_end(batches):
            rows = pa.Table.from_batches([batch]) if batch is not None else None
            if held is not None:
                rows = held if rows is None else pa.concat_tables([held, rows])
            if rows is None or not rows.num_rows:
                continue
            g1 = rows.column("g1").to_numpy()
            cold_tail = batch is not None and rows.column("n")[-1].as_py() > 0
            cut = int(np.searchsorted(g1, g1[-1])) if cold_tail else rows.num_rows
            held, rows = rows.slice(cut) if cold_tail else None, rows.slice(0, cut)
            if not cut:
                continue
            g1, g2, key, start, n = (rows.column(i).to_numpy() for i in range(5))
            single, done = n == 0, n < 0
            cold = np.flatnonzero(n > 0)
            out = [(key[done], start[done], -n[done])]
            if single.any():
                at = np.flatnonzero(single)
                a, b = g1[at], g2[at]
                later = np.zeros(len(at), bool)
                later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                later[0] = last is not None and last == (a[0], b[0])
                last = (a[-1], b[-1])
                out.append((key[at][later], start[at][later], np.ones(int(later.sum()), np.int64)))
            if len(cold):
                raw = rows.column("bytes").combine_chunks().take(pa.array(cold))
                pieces = [np.frombuffer(x.as_buffer(), np.uint8) for x in raw]
                h1, h2, owner, inside = _exploded(pieces, n[cold], window)
                key_, at = key[cold][owner], start[cold][owner] + inside
                order = np.lexsort((at, key_, h2, h1))
                a, b = h1[order], h2[order]
                later = np.zeros(len(a), bool)
                later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                at_, k_ = at[order][later], key_[order][later]
                out.append(_joined(k_, at_, np.ones(len(at_), np.int64)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "start", "n"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def _kept(window: int):
    """Per text the removed runs, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            listed = batch.column("_runs")
            rows = []
            for i, runs in enumerate(listed):
                own = data[offsets[i] : offsets[i + 1]]
                length = len(own)
                if not runs.is_valid or not len(runs.values):
                    rows.append((length, 0, 0, hashlib.sha256(own).hexdigest(), []))
                    continue
                start = runs.values.field(0).to_numpy(zero_copy_only=False)
                end = start + runs.values.field(1).to_numpy(zero_copy_only=False) + window - 1
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > end[:-1]
                begin, stop = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                kept = hashlib.sha256()
                for a, b in zip([0, *stop], [*begin, length], strict=True):
                    kept.update(own[a:b])
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(begin, stop, strict=True)]
                rows.append((length, int((stop - begin).sum()), len(begin), kept.hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, t) for x, t in zip(columns, types, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    hot_spans: int = HOT_SPANS,
    hot_rows: int = HOT_ROWS,
    task_bytes: int = TASK_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document its bytes, the bytes and runs removed, a hash of the rest, and the runs (bytes).

    A byte is removed if a string of ``window`` bytes that also starts earlier covers it: in a
    document with a smaller doc_id, or earlier in its own. Strings are judged on the input.
    """
    docs = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = _anchor_rows(docs, window, gram, hot_spans, task_bytes, block_bytes).repartition("gram").sortWithinPartitions("gram", "span", "key", "at")
    regions = stored(rows.mapInArrow(_regions(hot_rows), _REGIONS))
    compare = regions.filter("kind > 0").groupBy("key")
    compare = compare.agg(F.collect_list(F.struct("gram", "start", "n", "kind")).alias("_regions"))
    texts = docs.select("_key", "doc_id", "text")
    met = texts.join(compare, F.col("_key") == F.col("key"), "left")
    none = F.array().cast("array<struct<gram:long,start:long,n:long,kind:int>>")
    met = met.select("_key", "text", F.coalesce("_regions", none).alias("_regions"))
    order = ["g1", "g2", "key", "start"]
    sorted_ = _windows(met, window).repartition("g1", "g2").sortWithinPartitions(*order)
    found = sorted_.mapInArrow(_repeated_windows(window), "key long, start long, n long")
    removed = regions.filter("kind = 0").select("key", "start", "n").unionByName(found)
    runs = removed.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    whole = texts.join(runs, F.col("_key") == F.col("key"), "left").select("doc_id", "text", "_runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return whole.mapInArrow(_kept(window), schema)
