import hashlib
import random

import pytest

from casemetrics.llm.common import table
from casemetrics.llm.suffix_dedup import remove_repeats


def brute_force(rows, window=100):
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            string = raw[s : s + window]
            if string in seen:
                gone[s : s + window] = b"\x01" * window
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, gram string, key string, spans string")
    return [tuple(r)[:5] for r in remove_repeats(docs.repartition(5), **options).collect()]


def varied(seed):
    source = random.Random(seed)
    passages = ["".join(source.choices("abcé ñ\n", k=source.randint(90, 400))) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(source.randint(0, 5)):
            passage = source.choice(passages)
            kind = source.random()
            if kind < 0.4:
                parts.append(passage)
            elif kind < 0.6:
                parts.append(passage[source.randint(0, 60) : -source.randint(1, 60)])
            else:
                parts.append("".join(source.choices("xyz ", k=source.randint(1, 300))))
        rows.append((i, "".join(parts)))
    rows += [(90, "a" * 1000), (91, "ab" * 300), (92, "a" * 99), (93, "a" * 100), (94, None), (95, ""), (96, "pour " * 200)]
    return rows


@pytest.mark.parametrize("seed,hot", [(0, None), (1, 0), (2, 2)])
def test_against_brute_force(spark, seed, hot):
    small = {"hot_spans": hot, "hot_rows": (hot or 0) + 1, "task_bytes": 1500, "block_bytes": 700}
    rows = varied(seed)
    got = run(spark, [(*r, "x", "y", "z") for r in rows], **({} if hot is None else small))
    assert sorted(got) == brute_force(rows)


def test_shared_and_missing_ids(spark):
    text = "".join(random.Random(5).choices("abcdef ", k=300))
    rows = [(None, text), (4, text), (4, text), (4, text + "!"), (None, None)]
    got = run(spark, [(*r, "x", "y", "z") for r in rows])
    assert sorted(n for _, _, n, *_ in got) == [0, 0, 300, 300, 300]
    assert {n for i, _, n, *_ in got if i is None} == {0, 300}
    assert run(spark, []) == []


def test_all_documents_of_the_smallest_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r)[:5] for r in remove_repeats(docs).collect()) == brute_force(rows)
