import random
import re

import numpy as np
import pytest

from casemetrics.llm import near_dedup
from casemetrics.llm.common import table
from casemetrics.llm.near_dedup import _parity, near_duplicates, super_minhash
from casemetrics.llm.queries import QUERIES
from casemetrics.llm.text import mix


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(rows[i][0], len(sets[i]), rows[find(i)][0], find(i) == i) for i in range(len(rows))]


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, component string")
    return [tuple(r) for r in near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()]


def varied(seed):
    source = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß,", "NBSP\xa0x"]
    rows = []
    for _ in range(25):
        base = source.choices(vocabulary, k=source.randint(1, 120))
        for _ in range(source.randint(1, 8)):
            copy = list(base)
            for _ in range(source.randint(0, 3)):
                copy[source.randrange(len(copy))] = source.choice(vocabulary)
            text = source.choice([" ", "\n", " \t "]).join(copy)
            rows.append((len(rows), text.upper() if source.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = varied(seed) + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "one two"), (10_004, "ONE two")]
    got = run(spark, [(*r, "x", "y") for r in rows])
    assert sorted(got) == sorted(brute_force(rows))


@pytest.mark.parametrize("part_rows", [near_dedup.PART_ROWS, 3])
def test_chain_whose_ends_differ_and_mutual_strangers(spark, monkeypatch, part_rows):
    monkeypatch.setattr(near_dedup, "PART_ROWS", part_rows)
    words = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(12):
        words = list(words)
        words[15 * i + 7] = f"x{i}"
        chain.append((i, " ".join(words)))
    base = [f"v{i}" for i in range(100)]
    star = []
    for i in range(30):  # every copy is linked with the base, hardly any with another copy
        copy = list(base)
        copy[3 * i + 5] = f"y{i}"
        star.append((99 - i, " ".join(copy)))
    rows = sorted(chain + star + [(200, " ".join(base))])
    assert sorted(run(spark, [(*r, "x", "y") for r in rows])) == sorted(brute_force(rows))


def test_shared_and_missing_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words are here now ok"), (None, "a b c d e f"), (None, None)]
    got = run(spark, [(*r, "x", "y") for r in rows])
    assert sum(k for *_, k in got) == 3
    assert sorted((n, c) for i, n, c, _ in got if i == 5) == [(2, 5), (2, 5), (2, 5)]
    assert {c for i, n, c, _ in got if n == 2} == {5}


def test_empty(spark):
    assert run(spark, []) == []


def test_all_documents_of_the_smallest_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows))


def test_signatures_estimate_similarity_and_do_not_depend_on_the_batch():
    a = mix(np.arange(0, 400, dtype=np.uint64))
    b = mix(np.arange(100, 500, dtype=np.uint64))
    both = super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2, 512)
    assert abs((both[0] == both[1]).mean() - 0.6) < 0.08
    assert (super_minhash(b, np.zeros(400, int), 1, 512)[0] == both[1]).all()
    few = super_minhash(a[:3], np.zeros(3, int), 2, 64)
    assert np.isfinite(few[0]).all() and np.isinf(few[1]).all()
    assert (np.sort(few[0].astype(int)) < 64).all()


def test_parity_never_exceeds_the_difference():
    sets = [mix(np.arange(i * 7, 600 + i * 11, dtype=np.uint64)) for i in range(12)]
    made, owner = np.concatenate(sets), np.repeat(np.arange(12), [len(s) for s in sets])
    sketch = [np.array(p, np.int64).view(np.uint64) for p in _parity(made, owner, 12).to_pylist()]
    for i in range(12):
        for j in range(12):
            unlike = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            difference = len(np.setxor1d(sets[i], sets[j]))
            assert unlike <= difference and (difference - unlike) % 2 == 0
            assert unlike >= difference * 0.8


def test_the_query_keeps_every_row_of_the_smallest_id(spark, tmp_path):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_minhash_near_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
