import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from casemetrics.llm import quality, toxicity
from casemetrics.llm.common import table
from casemetrics.llm.linear import calibrated, hinge_weights, sampled, sigmoid, training_rows

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, score string, _label string"


@pytest.mark.parametrize("operator,label,parts,part", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(spark, operator, label, parts, part):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    got = operator.judge(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    outside = [zlib.crc32(str(i).encode()) % parts == part for i in got.index]
    assert (got.held_out == outside).all()
    known = labels.toPandas().set_index("doc_id").join(got)
    known = known[known.held_out]
    right = known[label] == known.predicted
    assert right.mean() > 0.93
    assert right[known[label] == 1].mean() > 0.9 and right[known[label] == 0].mean() > 0.9


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_without_labels_with_nulls_and_repeats(spark, operator):
    rows = [(None, "a"), (1, None), (1, ""), (2, "word " * 3), (2, "word " * 3)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = operator.judge(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    labels = [(1, 1, 1), (2, 0, 0), (2, 0, 0), (None, 1, 1), (3, None, None)]
    assert len(operator.judge(docs, spark.createDataFrame(labels, LABELS)).collect()) == 5
    assert operator.judge(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_kernel_tolerates_gaps_and_inserted_letters():
    telling = ["idiot", "moron", "clown", "worthless"]
    clean = ["there", "andthe", "thing", "ration", "table", "clear", "more", "worth", "nothing", "letter"]
    weights, bias = toxicity._fit(telling, clean, telling + clean)
    texts = ["you idiot", "you id.iot", "you idxiot", "you i d i o t", "mor-on", "the letter", "nothing more", ""]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    rows, size, text, word = toxicity.word_strings(data, offsets)
    best = np.full(len(texts), -2.0)
    np.maximum.at(best, text, toxicity.decide(rows, size, weights, bias)[word])
    assert best[:5].min() > 0 > best[5:].max()


def test_folded_table_equals_the_kernel():
    rows, size = toxicity._strings(["pathetic", "aaaa", "abcabcabc"])
    for (codes, values), row, n in zip(toxicity.explicit(rows, size), rows, size):
        plain = {}
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + toxicity.REACH + 1)):
                    key = (int(row[i]) << 12) | (int(row[j]) << 6) | int(row[k])
                    plain[key] = plain.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        norm = sum(v * v for v in plain.values()) ** 0.5
        assert {int(c): round(v, 9) for c, v in zip(codes, values)} == {k: round(v / norm, 9) for k, v in plain.items()}


def test_copies_carry_the_weight_of_one_text(spark, monkeypatch):
    source = random.Random(2)
    plain = ["".join(source.choices("abcdefgh", k=6)) for _ in range(60)]
    texts = [(" ".join(source.choices(plain, k=20)), 0) for _ in range(200)]
    for i in range(40):
        words = source.choices(plain, k=10)
        words.insert(source.randrange(11), ["idiot", "moron"][i % 2])
        texts.append((" ".join(words), 1))
    rare = " ".join("rare" + "".join(source.choices("klmnop", k=7)) for _ in range(100))
    texts += [(rare + "." * (i % 3), 1) for i in range(60)]
    texts += [(f"they quoted moron {' '.join(plain[:5])}", 0)] * 90
    monkeypatch.setattr(toxicity, "EXAMPLES", 80)
    fit, seen = toxicity._fit, []
    monkeypatch.setattr(toxicity, "_fit", lambda telling, *rest: seen.append(telling) or fit(telling, *rest))
    model = toxicity.train(spark.createDataFrame(texts, "text string, _label int"))
    assert sorted(seen[0]) == ["idiot", "moron"] and "table" in model


def test_hinge_and_calibration():
    random = np.random.default_rng(0)
    x = random.normal(size=(200, 3))
    y = np.where(x[:, 0] > 0, 1, -1)
    w = hinge_weights([(np.arange(3), r) for r in x], y, 3, epochs=100)
    assert ((x @ w > 0) == (y > 0)).mean() > 0.95
    slope, intercept = calibrated(x @ w, (y > 0).astype(int))
    p = sigmoid(slope * (x @ w) + intercept)
    assert slope > 0 and abs(p.mean() - 0.5) < 0.1


def test_copies_of_one_text_keep_the_bound_of_a_sample(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 2 = 0, 'one copied text', concat('text ', id)) as text")
    labels = spark.range(6000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as quality")
    rows = training_rows(docs, labels, "quality", F.lit(False))
    found = sampled(rows, 6000, 600).groupBy(F.col("text") == "one copied text").count().collect()
    assert all(220 < r["count"] < 380 for r in found) and len(found) == 2
