"""The filtering stages against plain versions, on documents with planted cases."""

from collections import Counter

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from casemetrics.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_leaks_and_copies_go_and_clean_documents_stay(spark):
    items = [r.text for r in table(spark, FOLDER, "benchmark").limit(3).collect()]
    clean = " ".join(f"word{i}" for i in range(120))
    rows = [(1, clean), (2, clean.upper()), (3, clean.replace("word7 ", "other ")), (4, f"start {items[0]} end"), (5, None), (6, "")]
    rows += [(10 + i, " ".join(f"own{i}x{j}" for j in range(40))) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near_duplicates"](spark, docs, FOLDER)
    assert one.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in one.collect()) == [1, 4, 5, 6, 10, 11, 12, 13, 14]
    left = stages["decontamination"](spark, docs, FOLDER)
    assert left.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 5, 6, 10, 11, 12, 13, 14]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, score double, kept boolean, predicted int"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
ODD = [
    (1, "Write to ann.lee@example.org or call +44 20 7946 0958 about the plan of the new bridge."),
    (1, "Write to ann.lee@example.org or call +44 20 7946 0958 about the plan of the new bridge."),
    (2, None),
    (2, None),
    (3, ""),
    (None, "A row that has no number but a text of some words."),
    (None, None),
    (4, LONG),
    (5, "\x00   \U0001f600 <|endoftext|> 4111 1111 1111 1111"),
]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if t is None else "en", None, None, "k", 0.5, True, 1) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", list(STAGES))
def test_every_stage_takes_an_empty_table(spark, odd, name):
    found = STAGES[name](spark, odd.limit(0), FOLDER)
    assert found.count() == 0
    assert name == "packing" or found.columns == corpus_pipeline.COLUMNS


def test_quality_judges_equal_texts_alike(spark, odd):
    found = STAGES["quality"](spark, odd, FOLDER)
    assert found.columns == corpus_pipeline.COLUMNS
    given, kept = Counter(ODD), Counter((r.doc_id, r.text) for r in found.collect())
    assert all(kept[row] == given[row] for row in kept)
    assert len({t in {text for _, text in kept} for t in (None, "")}) == 1  # null reads as empty


def test_one_of_repeated_rows_stays_and_rows_without_text_are_no_copies(spark, odd):
    found = STAGES["near_duplicates"](spark, odd, FOLDER)
    assert found.columns == corpus_pipeline.COLUMNS
    want = Counter(row for row in ODD if row[1] is None or row[1] == "") + Counter({row for row in ODD if row[1]})
    assert Counter((r.doc_id, r.text) for r in found.collect()) == want


def test_decontamination_keeps_all_clean_rows(spark, odd):
    found = STAGES["decontamination"](spark, odd, FOLDER)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(ODD)


def test_personal_data_goes_and_rows_stay(spark, odd):
    rows = STAGES["pii"](spark, odd, FOLDER).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    texts = [r.text for r in rows]
    assert texts.count(None) == 3 and "" in texts and LONG in texts
    seen = " ".join(filter(None, texts))
    assert not any(found in seen for found in ("ann.lee", "7946 0958", "4111 1111"))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_packing_is_whole_and_gapless(spark, odd):
    rows = STAGES["packing"](spark, odd, FOLDER).collect()
    one = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    one.no_truncation()
    one.no_padding()
    want = Counter()
    for i, text in ODD:
        want[i] += len(one.encode(text or "", add_special_tokens=False).ids) + 1
    got, places = Counter(), {}
    for r in rows:
        got[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
