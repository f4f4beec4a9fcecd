import random

import numpy as np
import pytest

from casemetrics.llm.decontaminate import Items, _matches, contaminated, edits, mark
from casemetrics.llm.text import words as words_of

DOCS = "doc_id long, text string, item_id string, start string"
ITEMS = "item_id long, text string, doc_id string"


def plain_edits(item, text):
    """Fewest word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def edited(source, words, n):
    words = list(words)
    for _ in range(n):
        i = source.randrange(len(words))
        kind = source.random()
        if kind < 0.4:
            words[i] = "changed"
        elif kind < 0.7:
            del words[i]
        else:
            words.insert(i, "added")
    return words


def test_against_brute_force(spark):
    source = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(source.choices(vocabulary, k=source.randint(6, 60)))) for i in range(30)]
    docs = []
    for i in range(200):
        words = source.choices(vocabulary, k=source.randint(0, 150))
        if i % 2:
            item = source.choice(items)[1].split()
            at = source.randint(0, len(words))
            words[at:at] = edited(source, item, source.randint(0, len(item) // 8))
        docs.append((i, " ".join(words).title()))
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = item.split(), text.lower().split()
            if plain_edits(a, b) <= len(a) // 5:
                want.add((d, i))
    frame = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS)
    found = contaminated(frame, spark.createDataFrame([(*r, "x") for r in items], ITEMS)).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.97 * len(want)
    for r in found:
        assert r.edits == plain_edits(dict(items)[r.item_id].split(), dict(docs)[r.doc_id].lower().split())


def test_edges(spark):
    items = [(1, "a b c d e f"), (2, None), (3, ""), (None, "q r s t u v"), (5, "one two")]
    docs = [(None, "x a b c d e f y"), (1, None), (2, ""), (3, "A B\nC d  e G"), (3, "A B\nC d  e G"), (4, "q r s t u v"), (6, "one x two"), (7, "one two")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS)
    listed = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in contaminated(frame, listed).collect()), key=str)
    assert got == sorted([(None, 1, 0), (3, 1, 1), (3, 1, 1), (4, None, 0), (7, 5, 0)], key=str)
    assert mark(frame, listed).count() == len(docs)
    assert contaminated(frame, listed.limit(0)).collect() == [] == contaminated(frame.limit(0), listed).collect()


def test_edits_equal_the_plain_table():
    random_ = np.random.default_rng(0)
    for _ in range(50):
        a, b = random_.integers(0, 5, random_.integers(1, 9)), random_.integers(0, 5, random_.integers(0, 20))
        assert edits(a, b)[0] == plain_edits(list(a), list(b))


@pytest.mark.parametrize("n", [1, 4, 5, 8, 10, 12, 15, 18, 20, 25, 30, 59])
def test_every_length_is_found_at_the_full_limit(n):
    source = random.Random(n)
    items = [[f"i{i}w{j}" for j in range(n)] for i in range(40)]
    texts = []
    for item in items:
        words = [f"t{source.randrange(500)}" for _ in range(80)]
        at = source.randint(0, len(words))
        words[at:at] = edited(source, item, n // 5)
        texts.append(words)
    raw = [" ".join(t).encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    _, _, hashes, text = words_of(data, offsets)
    got = _matches(Items([(i, " ".join(item)) for i, item in enumerate(items)]), hashes, text, len(texts))
    for i, (item, words) in enumerate(zip(items, texts, strict=True)):
        assert plain_edits(item, words) <= n // 5
        assert [(x["item_id"], x["edits"]) for x in got[i]] == [(i, plain_edits(item, words))]


def test_a_window_that_starts_before_its_text():
    texts = ["a b c d e f g h i j", "f g h i j k l m"]
    raw = [t.encode() for t in texts]
    _, _, hashes, text = words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = _matches(Items([(7, "a b f g h i j k l m")]), hashes, text, 2)
    assert got == {1: [{"item_id": 7, "start": 0, "edits": 2}]}
