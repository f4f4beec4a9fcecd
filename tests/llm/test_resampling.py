import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from casemetrics.llm import resampling
from casemetrics.llm.resampling import resample

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target, percent=5, min_words=20):
    held = [(d, *features(t)) for d, t in docs]
    s = Counter(b for _, _, f in held for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    rows = []
    for d, n, f in held:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = [r for r in rows if r[5] >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, target, **options):
    rows = spark.createDataFrame([(d, t, "x", 1.0) for d, t in docs], "doc_id long, text string, bucket string, score double")
    items = spark.createDataFrame([(i, t, "y") for i, t in enumerate(target)], "item_id long, text string, n string")
    return sorted(map(tuple, resample(rows, items, **options).collect()), key=str)


def texts(n):
    source = random.Random(5)
    parts = ["Ab", "b", "c9", "É", "ñandú", "日本", "x" * 70, "y" * 64, "z" * 65, "a-b", "\x00", "~", "…", "t"]
    return [" ".join(source.choices(parts, k=source.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_equals_brute_force(spark, percent):
    docs = [(i, t) for i, t in enumerate(texts(300))]
    docs += [(900, None), (901, ""), (902, " . "), (None, "q " * 30), (None, None), (5, docs[5][1]), (5, "other " * 25)]
    docs.append((903, "long words " * 40_000))
    target = ["ab b c9 é", None, "", "the É 日本 ab"]
    assert run(spark, docs, target, percent=percent) == brute(docs, target, percent)


def test_ties_and_many_equal_rows(spark):
    docs = [(7, "same text " * 15)] * 400 + [(i, "other words " * 15) for i in range(20)]
    got = run(spark, docs, ["same words"], percent=50)
    assert got == brute(docs, ["same words"], 50)
    assert sorted(r[4] for r in got if r[4] is not None) == list(range(1, 211))


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == []
    docs = [(i, t) for i, t in enumerate(texts(30))]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [(1, None)], []) == [(1, 0, 0, brute([(1, None)], [])[0][3], None, 0)]


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(texts(60))]
    monkeypatch.setattr(resampling, "SLICE_WORDS", 7)
    data = "\n".join(t.translate(LOWER) for _, t in docs) + "\n"
    at = [0]
    for _, t in docs:
        at.append(at[-1] + len(t.encode()) + 1)
    words = resampling.Words(data.encode(), resampling.np.array(at))
    found = Counter()
    for k in range(0, len(words.starts), 7):
        for text, sums in words.runs(k, min(k + 7, len(words.starts))):
            found.update(zip(text.tolist(), (sums % 10000).tolist(), strict=True))
    plain = Counter((i, b) for i, t in docs for b in features(t)[1])
    assert found == plain
