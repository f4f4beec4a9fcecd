"""Quality classifier: a support vector machine over naive Bayes features.

Features are indicators of byte n-grams (one to three bytes) and of shape n-grams: a word's shape
says which kinds of characters it holds, how long it is, and whether it repeats the word before.
Indicators are scaled by class log-count ratios, counted over all rows that may be learned from, and
a linear hinge-loss model is fitted to them by dual coordinate descent, on at most ``MAX_ROWS`` rows
chosen by hash; a fifth of those calibrates the score.

A null text is empty and scored by the intercept. Without labelled rows of both classes every score
is the share of label 1 (one half without any). Repeated rows are scored alike; other columns pass
through and are never inputs. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemetrics.llm.common import blocks, ship, utf8
from casemetrics.llm.linear import calibrated, held_out, hinge_weights, sampled, sigmoid, training_rows
from casemetrics.llm.text import words

MAX_ROWS = 8192
THRESHOLD = 0.3
FEATURES = 1 << 16
SMOOTHING = 1.0
INTERPOLATION = 0.25
BLOCK_BYTES = 1 << 20

_UPPER, _LOWER_, _DIGIT, _MARK = (1 << k for k in range(4))
KINDS = np.zeros(256, np.uint32)
KINDS[33:127] = _MARK
KINDS[48:58] = _DIGIT
KINDS[65:91] = _UPPER
KINDS[97:123] = _LOWER_
KINDS[128:] = _LOWER_
KINDS[[0x2C, 0x2E]] = 0


def _ids(code: np.ndarray, family: int) -> np.ndarray:
    x = (code.astype(np.uint32) + np.uint32(family << 27)) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return ((x ^ (x >> np.uint32(13))) & np.uint32(FEATURES - 1)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For every text the feature numbers it holds, with repeats."""
    codes = data.astype(np.uint32)
    two = codes[:-1] << 8 | codes[1:] if len(codes) > 1 else codes[:0]
    three = two[:-1] << 8 | codes[2:] if len(codes) > 2 else codes[:0]
    grams = [_ids(codes, 1), _ids(two, 2), _ids(three, 3)]
    starts, ends, hashes, text = words(data, offsets)
    kinds = np.zeros(len(starts), np.uint32)
    if len(starts):
        kinds = np.bitwise_or.reduceat(KINDS[data], starts)
    same = np.zeros(len(starts), np.uint32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    shape = kinds | same << 4 | np.minimum(ends - starts, 7).astype(np.uint32) << 5
    pairs = (shape[:-1] & 31) << 8 | shape[1:] & 31 if len(shape) > 1 else shape[:0]
    first = np.searchsorted(text, np.arange(len(offsets)))
    shapes = [_ids(shape, 4), _ids(shape & np.uint32(31), 5), _ids(pairs, 6)]
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        w, v = first[i], first[i + 1]
        found = [g[a : max(a, b - k)] for k, g in enumerate(grams)]
        found += [shapes[0][w:v], shapes[1][w:v], shapes[2][w : max(w, v - 1)]]
        yield np.concatenate(found)


def _each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    for first, last in blocks(offsets, BLOCK_BYTES):
        yield from features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each feature, by label, combined per task; feature -1 counts the texts."""
    total = np.zeros((2, FEATURES + 1), np.int64)
    for batch in batches:
        for label, found in zip(batch.column("_label").to_pylist(), _each(batch), strict=True):
            total[label, np.unique(found)] += 1
            total[label, FEATURES] += 1
    used = np.flatnonzero(total.any(axis=0))
    number = np.where(used == FEATURES, -1, used)
    yield pa.RecordBatch.from_arrays(
        [pa.array(number), pa.array(total[0, used]), pa.array(total[1, used])], names=["feature", "n0", "n1"]
    )


class _Rows(Sequence):
    """Texts as sparse rows (indices, values) of length one and a constant. Only the indices are kept:
    the values follow from the ratios, and would take twice the bytes of all indices and more."""

    def __init__(self, found: list[np.ndarray], ratio: np.ndarray):
        self.found, self.ratio = found, ratio
        self.sizes = [float(np.sqrt(ratio[i] @ ratio[i])) or 1.0 for i in found]

    def of(self, some: np.ndarray) -> _Rows:
        return _Rows([self.found[i] for i in some], self.ratio)

    def __len__(self) -> int:
        return len(self.found)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        index = self.found[i]
        return np.append(index, FEATURES), np.append(self.ratio[index] / self.sizes[i], 1.0)


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """A model from texts and their ``_label``. What reaches the driver is bounded by the features."""
    ship(rows.sparkSession, BLOCK_BYTES)
    counted = rows.mapInArrow(_counts, "feature long, n0 long, n1 long")
    counted = counted.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    texts = counted[counted.feature == -1]
    n0, n1 = (int(texts[c].sum()) for c in ("n0", "n1"))
    if not n0 or not n1:
        return {"constant": (n1 / (n0 + n1)) if n0 + n1 else 0.5}
    counts = np.full((2, FEATURES), SMOOTHING)
    held = counted[counted.feature >= 0]
    counts[0, held.feature] += held.n0
    counts[1, held.feature] += held.n1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["_label", "text"], ignore_index=True, na_position="first")
        labels = sample["_label"].to_numpy()
        x = _Rows([np.unique(x) for x in _each(pa.RecordBatch.from_pandas(sample[["text"]]))], ratio)
        check = np.arange(len(x)) % 5 == 0
        learn = np.flatnonzero(~check) if (~check).sum() > 20 else np.arange(len(x))
        weights = hinge_weights(x.of(learn), np.where(labels[learn] == 1, 1, -1), FEATURES + 1)
        # between naive Bayes (equal weights) and the support vector machine
        flat = np.abs(weights[:-1]).mean()
        weights[:-1] = (1 - INTERPOLATION) * flat + INTERPOLATION * weights[:-1]
        test = np.flatnonzero(check) if len(learn) < len(x) else learn
        margins = np.array([value @ weights[index] for index, value in x.of(test)])
        slope, intercept = calibrated(margins, labels[test])
        return pd.DataFrame([{"weights": weights.tolist(), "slope": slope, "intercept": intercept}])

    sample = sampled(rows, n0 + n1, max_rows)
    fitted = "weights array<double>, slope double, intercept double"
    model = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, fitted).first()
    weights = np.array(model["weights"])
    return {
        "vector": (weights[:-1] * ratio).astype(np.float64),
        "square": ratio**2,
        "bias": float(weights[-1]),
        "slope": model["slope"],
        "intercept": model["intercept"],
    }


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns with ``score`` and ``predicted`` added."""
    given = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(FEATURES, bool)
        for batch in batches:
            if "constant" in model:
                scores = np.full(batch.num_rows, model["constant"])
            else:
                margins = []
                for found in _each(batch):
                    flags[found] = True
                    index = np.flatnonzero(flags)
                    flags[index] = False
                    size = float(np.sqrt(model["square"][index].sum())) or 1.0
                    margins.append(model["vector"][index].sum() / size + model["bias"])
                scores = sigmoid(model["slope"] * np.array(margins, float) + model["intercept"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*given, "score", "predicted"],
            )

    ship(docs.sparkSession, BLOCK_BYTES)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("score double, predicted int").fields])
    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """Learn from labelled rows outside the held-out part and score every row."""
    outside = held_out(parts, part)
    model = train(training_rows(docs, labels, "quality", outside))
    slim = docs.select("doc_id", "text", outside.alias("held_out"))
    return score(slim, model).drop("text")
