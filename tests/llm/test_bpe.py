import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casemetrics.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "The cat's sat; they'll don't 'S", None, "", "  two  spaces \n\n end ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|",
    "É ñ ß 日本語 🙂 ​ 　x \x85 \x1c \x00", "١٢٣ ²½ 12345 ⅷ", "...!?–—", "aaaa" * 50, "ab" * 20_000, "\t" * 3000, " " * 5000 + "x",
]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, ids string, n_tokens int")


def test_digests_equal_the_library(spark):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "again"), (3, "again")]
    got = sorted(map(tuple, bpe.digests(frame(spark, rows), PATH).collect()), key=str)
    assert got == sorted(((d, *expected(t)) for d, t in rows), key=str)
    assert bpe.digests(frame(spark, []), PATH).collect() == []


def test_round_trip(spark):
    rows = list(enumerate(TEXTS))
    tokens = bpe.encode(frame(spark, rows), PATH)
    assert {r.doc_id: r.ids for r in tokens.collect()} == {
        d: LIBRARY.encode(t or "", add_special_tokens=False).ids for d, t in rows
    }
    assert {r.doc_id: r.text for r in bpe.decode(tokens, PATH).collect()} == {d: t or "" for d, t in rows}
    odd = spark.createDataFrame([(1, [222, 137, 64]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: LIBRARY.decode([222, 137, 64]), 2: "", 3: ""}


def test_blocks_change_nothing(monkeypatch):
    codec = bpe.codec(PATH)
    plain = [codec.encode(t or "") for t in TEXTS]
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 3)
    monkeypatch.setattr(bpe, "BLOCK_LETTERS", 5)
    assert [codec.encode(t or "") for t in TEXTS] == plain


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("abcdeinrst '\n ", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", " ", "'ll", "é", "1"])).map("".join)))
def test_any_text(text):
    ids = bpe.codec(PATH).encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).decode(ids) == text


def merged(word, ranks):
    """Plain merging: the pair of the lowest rank first, from the left."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_plain_merging(seed):
    source = random.Random(seed)
    known, merges = [b"a", b"b", b"c"], []
    for _ in range(25):
        u, v = source.choice(known), source.choice(known)
        if u + v not in known and len(u + v) < 9:
            known.append(u + v)
            merges.append((u, v))
    labels = {x: i for i, x in enumerate(known)}
    automaton = bpe.Automaton(labels, merges)
    ranks = {m: i for i, m in enumerate(merges)}
    for _ in range(300):
        word = bytes(source.choices(b"abc", k=source.randrange(1, 14)))
        assert [known[i] for i in automaton.encode(word)] == merged(word, ranks)
    for u in known:  # an arc leaves a state exactly where the two labels stay apart
        for v in known:
            if [known[i] for i in automaton.encode(u)] == [u] and [known[i] for i in automaton.encode(v)] == [v]:
                assert automaton.has_arc(u, v) == (merged(u + v, ranks) == [u, v])


def test_unordered_merges_are_refused():
    with pytest.raises(ValueError, match="earlier"):
        bpe.Automaton({b"a": 0, b"b": 1, b"ab": 2, b"abb": 3}, [(b"ab", b"b"), (b"a", b"b")])
