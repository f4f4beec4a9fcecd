"""Approximate nearest neighbours: p-stable hashing with several probes, and exact reranking.

The largest inner products are the smallest distances once every indexed vector gets one more
coordinate that brings it to the largest norm, and every query a zero there. Each table hashes by
Gaussian projections, cut into cells of one width; a query visits, next to its own bucket, the
perturbed buckets that its distances to the cell borders make likeliest, in that order. All
candidates of a bucket are ranked by their exact products.

Equal vectors are one: only the smallest ids that can be among the nearest are indexed, and equal
queries are searched once. Buckets are counted and split into parts of bounded size on both sides, so
no task holds a large bucket. At full recall of ``tables`` x ``probes`` buckets the work grows with
queries times bucket size; vectors without any structure, as in tests, need large shares of it.

Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows without an
id; vectors are compared with those of their own length. Rows that repeat an id and vector are one.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemetrics.llm.common import ship, stored

NEAREST = 20
TABLES = 6
PROJECTIONS = 4
WIDTH = 1.6
PROBES = 40
PART_ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; single precision stays as narrow as it was given."""
    v = F.col("embedding")
    if vectors.schema["embedding"].dataType.elementType != T.FloatType():
        v = v.cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    return kept.filter(F.coalesce(good, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _norm2(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


class Tables:
    """Projections of every table for vectors of one length."""

    def __init__(self, size: int, tables: int, projections: int, width: float, scale: float):
        random = np.random.default_rng(size)
        self.axes = random.normal(size=(tables, size + 1, projections)) / scale
        self.shift = random.uniform(0, width, size=(tables, 1, projections))
        self.width = width
        self.moves = np.array(list(product((0, -1, 1), repeat=projections)))

    def places(self, x: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,tdk->tnk", x, self.axes) + self.shift) / self.width

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """Cells of the likeliest buckets, nearest first: tables, rows, probes, projections."""
        place = self.places(x)
        cell = np.floor(place)
        part = place - cell
        far = np.stack([np.zeros_like(part), part**2, (1 - part) ** 2])  # stay, down, up
        score = sum(far[self.moves[:, k]][..., k] for k in range(self.moves.shape[1]))
        order = np.argsort(np.moveaxis(score, 0, -1), axis=-1, kind="stable")[..., :most]
        return cell[:, :, None, :].astype(np.int64) + self.moves[order]


def _bucket_rows(frame: DataFrame, probes: int | None, shape: tuple, longest: float, ids: str) -> DataFrame:
    """One row per vector and bucket; with ``probes`` for queries, which stay at norm as given."""
    tables, projections, width = shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Tables] = {}
        weights = np.array([1_000_003**k % 2**61 for k in range(projections)], np.int64)
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len)):
                made.setdefault(size, Tables(size, tables, projections, width, longest))
                x = _matrix(part["v"])
                rest = np.zeros(len(x)) if probes else np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
                full = np.column_stack([x, rest])
                if probes:
                    cells = made[size].probes(full * (longest / np.linalg.norm(x, axis=1))[:, None], probes)
                else:
                    cells = np.floor(made[size].places(full)).astype(np.int64)[:, :, None, :]
                key = (cells * weights).sum(axis=-1)
                for t in range(tables):
                    for p in range(key.shape[2]):
                        bucket = (key[t, :, p] * 64 + t) * 8192 + size
                        yield pd.DataFrame({"bucket": bucket, "id": part[ids].to_numpy(), "v": part["v"].to_numpy()})

    rows = frame.select(ids, "v")
    if probes:
        # a query becomes many rows, so tasks are not joined by the bytes that come in
        rows = rows.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), ids)
    return rows.mapInPandas(run, f"bucket long, id long, v {frame.schema['v'].dataType.simpleString()}")


def _split(rows: DataFrame, other: DataFrame, own: str, theirs: str, part_rows: int) -> DataFrame:
    """Rows with their own part of the bucket, once for every part of the other side."""
    sized = rows.join(other, "bucket")
    own_part = F.pmod(F.xxhash64("id"), F.ceil(F.col(own) / part_rows)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.ceil(F.col(theirs) / part_rows).cast("int") - 1))
    return sized.withColumn("_own", own_part).withColumn("_other", every).select("bucket", "_own", "_other", "id", "v")


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = NEAREST,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    probes: int = PROBES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row that ``queries`` picks."""
    ship(vectors.sparkSession)
    rows = stored(usable(vectors))
    longest = rows.agg(F.sqrt(F.max(_norm2("v"))).alias("m")).first()["m"] or 1.0
    shape = (tables, projections, width)
    by_vector = Window.partitionBy("h1", "h2").orderBy("vec_id")
    same = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    indexed = same.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= k + 1)
    asked = same.filter(queries)
    once = asked.groupBy("h1", "h2").agg(F.min("vec_id").alias("asked"))
    firsts = asked.join(once, (asked.h1 == once.h1) & (asked.h2 == once.h2) & (asked.vec_id == once.asked)).select("asked", "v")
    index = _bucket_rows(indexed, None, shape, longest, "vec_id")
    probed = _bucket_rows(firsts, probes, shape, longest, "asked")
    sizes = stored(
        index.groupBy("bucket").agg(F.count("*").alias("n_index")).join(probed.groupBy("bucket").agg(F.count("*").alias("n_asked")), "bucket")
    )
    left = _split(probed, sizes, "n_asked", "n_index", part_rows).toDF("bucket", "a", "b", "id", "v")
    right = _split(index, sizes, "n_index", "n_asked", part_rows).toDF("bucket", "b", "a", "id", "v")

    def best(queries_: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_) or not len(found):
            return pd.DataFrame({"asked": [], "vec_id": [], "score": []})
        y, ids = _matrix(found["v"]), found["id"].to_numpy()
        columns, longest_here = np.ascontiguousarray(y.T), np.sqrt((y**2).sum(axis=1).max())
        most, out = min(k + 1, len(ids)), []
        for first in range(0, len(queries_), 512):
            part = queries_.iloc[first : first + 512]
            x = _matrix(part["v"])
            rough = x @ y.T
            limit = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
            # more than two products can differ from their exact sums, so that all possible ties stay
            slack = 4 * y.shape[1] * np.finfo(float).eps * longest_here * np.sqrt((x**2).sum(axis=1))
            q, c = np.nonzero(rough >= (limit - slack)[:, None])
            score = np.zeros(len(q))
            for own, theirs in zip(np.ascontiguousarray(x.T), columns, strict=True):
                score += own[q] * theirs[c]  # one sum in one order, so equal vectors score alike
            order = np.lexsort((ids[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < most
            asked_ids = part["id"].to_numpy()[q[kept]]
            out.append(pd.DataFrame({"asked": asked_ids, "vec_id": ids[c[kept]], "score": score[kept]}))
        return pd.concat(out)

    keys = ["bucket", "a", "b"]
    candidates = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "asked long, vec_id long, score double")
    # a candidate found in several tables has the same score in each, so a dense rank counts it once
    by_score = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    some = candidates.withColumn("_n", F.dense_rank().over(by_score)).filter(F.col("_n") <= k + 1)
    scored = stored(some.select("asked", "vec_id", "score").distinct())
    members = asked.join(once, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "asked")
    answers = members.join(scored, "asked").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
