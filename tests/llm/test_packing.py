import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casemetrics.llm.packing import _parts, best_two_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The cat, sat. on the mat...", None, "", "  lead and trail \n", "it's 12,345.67 don't!!", "É café ñ, ß.",
    "a b \x1c c\x1fd e f", "<|endoftext|> is text", "word " * 5000, "....,,,, a., b,. c.", "A.B,C. d,e.",
    "same same", "same same",
]


def reference(text):
    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def packed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    return pack(docs, PATH, **options).collect()


def test_ids_and_places(spark):
    rows = packed(spark, [(i, t, "x") for i, t in enumerate(TEXTS)])
    for i, text in enumerate(TEXTS):
        ids = reference(text)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        cuts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [
            (2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)
        ]
    check_places(rows)


def check_places(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_rows_without_or_with_shared_ids_and_many_shards(spark):
    rows = packed(spark, [(None, "a b", None), (7, "a b", None), (7, "a b", None), (7, "c", None)] * 30, shard_pieces=20)
    assert len(rows) == 120
    check_places(rows)


def test_equal_rows_are_dealt_to_many_shards(spark):
    rows = packed(spark, [(7, "a b", None)] * 2000, shard_pieces=100)
    assert len({r.sequence_id >> 32 for r in rows}) >= 18
    check_places(rows)


def test_shards_are_counted_from_pieces(spark):
    rows = packed(spark, [(i, "word " * 300, None) for i in range(4)], capacity=10, shard_pieces=20)
    assert len(rows) == 4 * 31 and len({r.sequence_id >> 32 for r in rows}) > 4
    check_places(rows, 10)


def test_empty(spark):
    assert packed(spark, []) == []


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, gap in enumerate(gaps) if gap >= x), None)
        if at is None:
            gaps.append(capacity - x)
        else:
            gaps[at] -= x
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit_keeps_every_piece_and_is_tight(seed):
    random = np.random.default_rng(seed)
    lengths = random.integers(1, 101, 3000)
    counts = np.bincount(lengths, minlength=101)
    got, bins = np.zeros(101, int), 0
    for times, content in best_two_fit(counts):
        assert sum(content) <= 100
        bins += times
        for x in content:
            got[x] += times
    assert (got == counts).all()
    assert bins <= first_fit_decreasing(lengths, 100) * 1.01 + 1


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(11, int)
    for x in (6, 3, 2, 2):
        counts[x] += 1
    assert next(best_two_fit(counts)) == (1, [6, 2, 2])


def test_parts_cover_all_but_white_space():
    data = np.frombuffer("ab. c, ..\n d.".encode(), np.uint8)
    starts, ends = _parts(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", ".", "c", ",", "..", "d", "."]
