import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from casemetrics.llm import divergence
from casemetrics.llm.divergence import divergence as audit

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    """Plain counting over all kept terms, term by term."""
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    found = []
    for lang in {a for _, a, _ in rows}:
        docs, times = Counter(), {}
        for text, _, source in [r for r in rows if r[1] == lang]:
            terms = TERM.findall(text.translate(LOWER))
            docs.update(set(terms))
            times.setdefault(source, Counter()).update(terms)
        kept = sorted(t for t, n in docs.items() if n >= least)
        every = sum(times.values(), Counter())
        shares = {}
        for name, counts in [*times.items(), (None, every)]:
            size = sum(counts[t] for t in kept) + 5 * len(kept)
            shares[name] = [1 + (counts[t] + 5) * 10**9 // size for t in kept]
        for g in times:
            pairs = [(q, sum(abs(x - y) for x, y in zip(shares[g], shares[q], strict=True))) for q in times if q != g]
            own = zip(kept, shares[g], shares[None], strict=True)
            above = [(t, p - q) for t, p, q in own if times[g][t] > 0 and p > q]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", above, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, g, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(found)


def run(spark, rows, **options):
    columns = "text string, lang string, source string, value string, word int, n long"
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], columns)
    got = audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def corpus(n, words, sources, seed=3):
    pick = random.Random(seed)
    vocabulary = [f"{c}{d}" for c in "aBéñ日zq" for d in "stuvwxyÀ"] + ["The", "the", "a_b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [
        (" ".join(pick.choices(vocabulary, weights, k=pick.randrange(words))), pick.choice(["en", "de", None, ""]), pick.choice(sources))
        for _ in range(n)
    ]


@pytest.mark.parametrize("least,top", [(30, 50), (1, 3), (10_000, 50)])
def test_equals_brute_force(spark, least, top):
    rows = corpus(400, 40, ["s1", "s2", "S3", None, "é", "日"])
    rows += [(None, "en", "mute"), ("", "en", "mute"), ("1 2 3", None, "x"), ("lone text", "xx", "only"), (None, None, None)]
    rows += [("repeated row of words", "de", "hot")] * 200
    rows.append(("very long " * 200_000, "en", "s1"))
    assert run(spark, rows, min_documents=least, top_terms=top) == brute(rows, least, top)


def test_equals_its_sql(spark):
    rows = corpus(300, 60, ["s1", "s2", "s3", None])
    documents = pd.DataFrame(rows, columns=["text", "lang", "source"])  # noqa: F841  read by the SQL
    sql = duckdb.sql(divergence.SQL.replace("FROM documents", "FROM documents")).fetchall()
    assert run(spark, rows) == sorted(sql)


def test_small_chunks_and_slices_change_nothing(spark, monkeypatch):
    rows = corpus(300, 60, [f"s{i}" for i in range(9)])
    monkeypatch.setattr(divergence, "CHUNK_LEVELS", 64)
    monkeypatch.setattr(divergence, "SLICE_SOURCES", 2)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 3)
    assert run(spark, rows, min_documents=5) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shares_stay_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 1000)], "n long, size long, v long")
    got = df.select(divergence._share("n", "size").alias("p")).first().p
    assert got == 1 + (4 * 10**12 + 5) * 10**9 // (9 * 10**12 + 5000)
