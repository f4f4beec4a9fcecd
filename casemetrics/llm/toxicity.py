"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over the letter triples that both hold as subsequences, a decay to
the power of the places they span, so gapped and inserted letters weaken a match but do not end it.
A sentence is judged by its strongest word: letters alone count, and letters spelt out one by one
are put together.

Landmarks are the words that hardly any but labelled toxic texts hold, in many different contexts,
and some frequent words of the rest; both are counted over all different texts that may be learned
from, so copies of a text count once. All words of toxic texts are ranked by contexts before any cut. The machine is fitted by dual coordinate descent to Nystroem
features of the telling words of toxic sentences and of words of clean sentences, and again with the
clean words it found hardest, all in bounded numbers. Since the kernel is a sum over triples,
landmarks, Nystroem map and weights fold into one weight per triple; only a word's own norm is left.

A null or empty text scores as a text without telling words. Without labelled rows of both classes
every score is the share of label 1 (zero without any). Other columns are never inputs. Repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import blocks, ship, stored, utf8
from casemetrics.llm.linear import calibrated, held_out, hinge_weights, sampled, sigmoid, training_rows
from casemetrics.llm.text import IS_SPACE, prefix_sums, span_hashes
from casemetrics.operators.sizing import lookup_join

LANDMARKS = 256
EXAMPLES = 4096
MAX_ROWS = 8192
THRESHOLD = 0.3
DECAY = 0.5
REACH = 6
LETTERS = 16
MIN_G2 = 20.0
PURITY = 0.8
ROUNDS = 3
BLOCK_BYTES = 1 << 20

#: Letters of a byte: a to z in either case, and the bytes of others folded to 32; 0 is no letter.
SYMBOLS = np.zeros(256, np.uint8)
SYMBOLS[65:91] = np.arange(1, 27)
SYMBOLS[97:123] = np.arange(1, 27)
SYMBOLS[128:] = 27 + (np.arange(128, 256) & 31)
TRIPLES = 1 << 18


def word_strings(data: np.ndarray, offsets: np.ndarray):
    """Distinct words as rows of up to ``LETTERS`` symbols, their lengths, and the text and the
    distinct word of every occurrence. Longer words are read in overlapping stretches."""
    symbol = SYMBOLS[data]
    at = np.flatnonzero(symbol)
    gaps = np.cumsum(IS_SPACE[data])
    text = np.searchsorted(offsets, at, "right") - 1
    token = gaps[at] + text * 1  # a new text starts a new word as well
    new = np.ones(len(at), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    if len(first):  # letters spelt out one by one
        lone = length == 1
        join = np.zeros(len(first), bool)
        join[1:] = lone[1:] & lone[:-1] & (text[first][1:] == text[first][:-1])
        first = first[~join]
        length = np.diff(np.append(first, len(at)))
    pieces = np.maximum(1, -(-(length - LETTERS) // (LETTERS // 2)) + 1)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + step * (LETTERS // 2)
    stop = np.minimum(begin + LETTERS, np.repeat(first + length, pieces))
    keep = stop - begin >= 3
    begin, stop = begin[keep], stop[keep]
    letters = symbol[at]
    hashes = span_hashes(prefix_sums(letters), begin, stop)
    _, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    size = (stop - begin)[where]
    padded = np.append(letters, np.zeros(LETTERS, np.uint8))
    rows = padded[begin[where][:, None] + np.arange(LETTERS)]
    rows[np.arange(LETTERS) >= size[:, None]] = 0
    return rows, size, text[begin] if len(begin) else begin, inverse


def _triples():
    for i in range(LETTERS):
        for k in range(i + 2, min(LETTERS, i + REACH + 1)):
            for j in range(i + 1, k):
                yield i, j, k, DECAY ** (k - i + 1)


def _codes(rows: np.ndarray, i: int, j: int, k: int) -> np.ndarray:
    return (rows[:, i].astype(np.int32) << 12) | (rows[:, j].astype(np.int32) << 6) | rows[:, k]


def explicit(rows: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each word's triples and their kernel weights, scaled to norm one."""
    codes, weight = [], []
    for i, j, k, w in _triples():
        codes.append(_codes(rows, i, j, k))
        weight.append(np.where(k < size, w, 0.0))
    codes, weight = np.stack(codes, 1), np.stack(weight, 1)
    out = []
    for c, w in zip(codes, weight, strict=True):
        distinct, inverse = np.unique(c[w > 0], return_inverse=True)
        value = np.bincount(inverse, weights=w[w > 0], minlength=len(distinct))
        out.append((distinct, value / (float(np.sqrt(value @ value)) or 1.0)))
    return out


def decide(rows: np.ndarray, size: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of each word: its triples' weights over its norm, plus the bias."""
    order = np.argsort(size, kind="stable")
    rows, size = rows[order], size[order]
    total, least = np.zeros(len(rows)), np.zeros(len(rows))
    for i, j, k, w in _triples():
        a = np.searchsorted(size, k, "right")
        if a < len(rows):
            total[a:] += w * table[_codes(rows[a:], i, j, k)]
            least[a:] += w * w
    value = np.full(len(rows), bias - 1.0)
    # without repeated triples the norm is ``least``; it can only be larger
    near = np.flatnonzero(total / np.sqrt(np.maximum(least, 1e-12)) + bias > -1.0)
    for part in np.array_split(near, max(1, len(near) // 4096)):
        value[part] = [table[c] @ v + bias for c, v in explicit(rows[part], size[part])] if len(part) else []
    out = np.empty(len(rows))
    out[order] = np.maximum(value, -2.0)
    return out


def _margins(batch: pa.RecordBatch, table: np.ndarray, bias: float) -> np.ndarray:
    data, offsets = utf8(batch.column("text"))
    out = np.full(batch.num_rows, -2.0)
    for first, last in blocks(offsets, BLOCK_BYTES):
        own = offsets[first : last + 1] - offsets[first]
        rows, size, text, word = word_strings(data[offsets[first] : offsets[last]], own)
        if len(text):
            np.maximum.at(out, first + text, decide(rows, size, table, bias)[word])
    return out


def _strings(words: list[str]):
    """The same rows for given words."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    rows, size, text, word = word_strings(data, offsets)
    _, where = np.unique(text, return_index=True)
    return rows[word[where]], size[word[where]]


def letter_texts(rows: DataFrame) -> DataFrame:
    """Distinct labelled texts by their words' letters, so that copies carry the weight of one text."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\s]+", "")
    return rows.select("_label", F.trim(F.regexp_replace(letters, r"\s+", " ")).alias("letters")).distinct()


def word_counts(texts: DataFrame) -> DataFrame:
    """Distinct labelled texts, and toxic ones among them, that hold each word."""
    held = texts.select("_label", F.explode(F.array_distinct(F.split("letters", " "))).alias("word"))
    held = held.filter(F.length("word").between(3, LETTERS))
    return held.groupBy("word").agg(F.count("*").alias("n"), F.sum("_label").alias("toxic"))


def telling_words(texts: DataFrame, counts: DataFrame, share: float) -> list[str]:
    """Words of toxic texts alone that stand between many different neighbours, most first."""
    pure = counts.filter(F.col("toxic") >= F.col("n") * PURITY).select("word")

    def placed(word, i):
        around = F.xxhash64(F.get("words", i - 1), F.get("words", i + 1))
        return F.struct(word.alias("word"), around.alias("around"))

    toxic = texts.filter("_label = 1").select(F.split("letters", " ").alias("words"))
    met = toxic.select(F.explode(F.transform("words", placed)).alias("x")).select("x.*")
    met = lookup_join(met, pure, ["word"], how="left_semi", spread_by=["around"])
    places = met.distinct().groupBy("word").agg(F.count("*").alias("places"))
    worth = 2 * F.col("places") * float(np.log(1 / share))
    found = places.orderBy(F.desc("places"), "word").limit(EXAMPLES // 4).withColumn("worth", worth).collect()
    return [r.word for r in found if r.worth >= MIN_G2] or [r.word for r in found[:8]]


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """A model from texts and their ``_label``; the words and rows that reach the driver are bounded."""
    ship(rows.sparkSession)
    totals = rows.agg(F.count("*").alias("n"), F.sum("_label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not toxic or toxic == n:
        return {"constant": float(toxic / n) if n else 0.0}
    texts = stored(letter_texts(rows))
    share = texts.agg(F.avg("_label")).first()[0]
    counts = stored(word_counts(texts))
    telling = telling_words(texts, counts, share)
    plain = counts.filter(F.col("toxic") < F.col("n") * 0.5).select("word", "n")
    frequent = [r.word for r in plain.orderBy(F.desc("n"), "word").limit(EXAMPLES // 2).collect()]
    others = [r.word for r in plain.orderBy(F.xxhash64("word"), "word").limit(EXAMPLES // 2).collect()]
    told = set(telling)
    clean = [w for w in dict.fromkeys(frequent + others) if w not in told]
    if not telling or not clean:
        return {"constant": float(toxic / n)}
    marks = telling[: LANDMARKS // 2] + clean[: LANDMARKS // 4]
    weights, bias = _fit(telling, clean, marks)
    for _ in range(ROUNDS - 1):
        hard = [w for w in _hardest(plain, weights, bias) if w not in told]
        clean = list(dict.fromkeys(clean + hard))
        marks = list(dict.fromkeys(marks + hard[: LANDMARKS // 2]))
        weights, bias = _fit(telling, clean, marks)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _margins(batch, weights, bias)
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column("_label")], names=["margin", "_label"])

    seen = sampled(rows, n, max_rows).mapInArrow(margins, "margin double, _label int").toPandas()
    slope, intercept = calibrated(seen["margin"].to_numpy(), seen["_label"].to_numpy())
    return {"table": weights, "bias": bias, "slope": slope, "intercept": intercept}


def _hardest(plain: DataFrame, weights: np.ndarray, bias: float) -> list[str]:
    """The words of clean texts that the machine takes most for toxic ones."""

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            raw = [w.encode() for w in words]
            rows, size, text, word = word_strings(
                np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
            )
            value = np.full(len(words), -2.0)
            if len(text):
                np.maximum.at(value, text, decide(rows, size, weights, bias)[word])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(value)], names=["word", "value"])

    values = plain.select("word").mapInArrow(valued, "word string, value double").filter("value > -1")
    return [r.word for r in values.orderBy(F.desc("value"), "word").limit(EXAMPLES // 2).collect()]


def _fit(telling: list[str], clean: list[str], marks: list[str]) -> tuple[np.ndarray, float]:
    """Triple weights and bias of a machine on Nystroem features over the landmarks."""
    rows, size = _strings(marks)
    base = explicit(rows, size)
    held = np.unique(np.concatenate([c for c, _ in base]))
    dense = np.zeros((len(base), len(held) + 1), np.float32)  # the last column: triples of no landmark
    for i, (c, v) in enumerate(base):
        dense[i, np.searchsorted(held, c)] = v

    def kernel(words: list[str]) -> np.ndarray:
        out = []
        for c, v in explicit(*_strings(words)):
            at = np.minimum(np.searchsorted(held, c), len(held) - 1)
            out.append(dense[:, np.where(held[at] == c, at, len(held))] @ v)
        return np.array(out, float)

    gram = kernel(marks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector * (1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    mapped = kernel(telling + clean) @ root
    signs = np.where(np.arange(len(mapped)) < len(telling), 1, -1)
    every = np.arange(mapped.shape[1] + 1)
    weights = hinge_weights([(every, np.append(k, 1.0)) for k in mapped], signs, len(every), cost=4.0, epochs=40)
    table = np.zeros(TRIPLES)
    table[held] = ((root @ weights[:-1]) @ dense)[:-1]
    return table, float(weights[-1])


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "constant" in model:
                scores = np.full(batch.num_rows, model["constant"])
            else:
                found = _margins(batch, model["table"], model["bias"])
                scores = sigmoid(model["slope"] * found + model["intercept"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """Learn from labelled rows outside the held-out part and score every row."""
    outside = held_out(parts, part)
    model = train(training_rows(docs, labels, "toxic", outside))
    return score(docs.select(F.col("doc_id").cast("long"), "text", outside.alias("held_out")), model)
