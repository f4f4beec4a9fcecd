import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemetrics.operators import latest, sizing
from casemetrics.operators.latest import latest_one, latest_with_ties
from casemetrics.operators.percentiles import group_percentiles


def events(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([7, 8, 9]), f"e{i}") for i in range(600)]
    rows += [(f"k{i % 40}", rng.randrange(20), f"f{i}") for i in range(400)]
    rows += [("null", None, "a"), ("null", None, "b"), ("null", 5, "c"), (None, 1, "d"), (None, 2, "e")]
    return rows, spark.createDataFrame(rows, "k string, v int, name string")


def expected_latest(rows):
    best = {}
    for k, v, _ in rows:
        rank = float("inf") if v is None else v
        best[k] = max(best.get(k, float("-inf")), rank)
    return sorted(
        (str(k), v, n) for k, v, n in rows if (float("inf") if v is None else v) == best[k]
    )


@pytest.mark.parametrize("hot_rows", [2, 100, 10**6])
def test_latest_keeps_ties_with_hot_keys(spark, hot_rows):
    rows, df = events(spark)
    found = latest_with_ties(df, ["k"], "v", hot_rows=hot_rows).collect()
    assert sorted((str(k), v, n) for k, v, n in found) == expected_latest(rows)


@pytest.mark.parametrize("copies", [1, 7, 1000])
def test_one_pass_keeps_ties_and_copies(spark, monkeypatch, copies):
    monkeypatch.setattr(latest, "COPIES", copies)
    rows, _ = events(spark)
    rows = [*rows, *[("hot", 9, "again")] * 50, *[("null", None, "a")] * 3]
    df = spark.createDataFrame(rows, "k string, v int, name string")
    found = latest.latest_in_one_pass(df, ["k"], "v").collect()
    assert sorted((str(k), v, n) for k, v, n in found) == expected_latest(rows)


def test_many_equal_rows_are_one_row_in_the_shuffle(spark):
    same = spark.range(100_000, numPartitions=8).selectExpr("'k' AS k", "1 AS v")
    assert latest.latest_in_one_pass(same, ["k"], "v").count() == 100_000


def test_latest_plan_limits_before_the_shuffle(spark):
    _, df = events(spark)
    plan = latest_with_ties(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_identical_ties_of_a_hot_key_stay_spread(spark):
    same = spark.range(100_000, numPartitions=8).selectExpr("'k' AS k", "1 AS v")
    found = latest_with_ties(same, ["k"], "v", hot_rows=1000)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 100_000 and len(tasks) == 8


def test_latest_one_breaks_ties(spark):
    _, df = events(spark)
    found = {r.k: r.name for r in latest_one(df, ["k"], "v", ["name"]).collect()}
    assert found["null"] == "b" and len(found) == 43


FRACTIONS = {"p90": 0.9, "p75": 0.75, "p50": 0.5, "p0": 0.0, "p100": 1.0}


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_percentiles_are_exact(spark, hot_rows):
    rng = random.Random(11)
    rows = [("a", 1, rng.randrange(-(10**12), 10**13)) for _ in range(500)]
    rows += [("a", 2, rng.choice([5, 86_400_000_000, -3])) for _ in range(300)]
    rows += [("b", 1, 7), (None, 1, 3), (None, 1, 4), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, m int, us bigint")
    found = {
        (r.g, r.m): r
        for r in group_percentiles(df, ["g", "m"], "us", FRACTIONS, hot_rows=hot_rows).collect()
    }
    groups = {}
    for g, m, us in rows:
        groups.setdefault((g, m), []).append(us)
    assert set(found) == set(groups)
    for key, values in groups.items():
        values = [v for v in values if v is not None]
        for name, p in FRACTIONS.items():
            if not values:
                assert found[key][name] is None
            else:
                assert found[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-6)


def test_percentiles_without_any_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", -1)
    rows = [("a", i % 97) for i in range(500)] + [("b", 7), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g string, us bigint")
    found = {r.g: r.p50 for r in group_percentiles(df, ["g"], "us", {"p50": 0.5}, hot_rows=2).collect()}
    middle = float(np.quantile([i % 97 for i in range(500)], 0.5))
    assert found == {"a": middle, "b": 7.0, None: 3.5}


def test_percentiles_grow_with_the_fraction(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("g"), F.xxhash64("id").alias("h"))
    df = df.select("g", F.pmod("h", F.lit(10**12)).alias("us"))
    for r in group_percentiles(df, ["g"], "us", FRACTIONS, hot_rows=100).collect():
        assert r.p0 <= r.p50 <= r.p75 <= r.p90 <= r.p100
