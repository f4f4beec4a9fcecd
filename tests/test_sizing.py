import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from casemetrics.operators import sizing as S
from casemetrics.plans.ttr_percentiles import ttr_percentiles
from casemetrics.plans.views import open_case_metrics, resolved_case_metrics
from workload import roles


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(2)
    keys = ["hot"] * 500 + [None] * 200 + [f"k{rng.randrange(50)}" for _ in range(300)]
    fact = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    lookup = [("hot", 1), ("hot", 2), (None, 9)] + [(f"k{i}", i) for i in range(0, 50, 2)]
    return fact, spark.createDataFrame(lookup, "k string, v int")


def rows(df):
    return sorted(map(str, df.select("id", "k", "v").collect()))


@pytest.mark.parametrize("hot_rows", [1, 100, 10**6])
def test_salted_join_equals_plain_join(sides, hot_rows):
    fact, lookup = sides
    salted = S.salted_left_join(fact, lookup, ["k"], ["id"], hot_rows=hot_rows, salts=8)
    assert rows(salted) == rows(fact.join(lookup, "k", "left"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_join_beyond_the_limit(sides, how):
    fact, lookup = sides
    found = S.lookup_join(fact, lookup, ["k"], fits=False, how=how)
    plain = fact.join(lookup, "k", how)
    assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    top_join = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "rightHint=(strategy=broadcast)" not in top_join


def test_hot_rows_spread_over_salts(sides):
    fact, _ = sides
    hot = S.hot_key_hashes(fact, ["k"], 100)
    salted = S.with_salt(fact, ["k"], hot, ["id"], salts=8)
    spread = {r.k: r.n for r in salted.groupBy("k").agg(F.countDistinct("_salt").alias("n")).collect()}
    assert spread["hot"] == 8 and spread[None] == 8
    assert {n for k, n in spread.items() if k not in ("hot", None)} == {1}


def test_left_join_many(sides):
    fact, lookup = sides
    cases = lookup.select("k").filter("k is not null").distinct().union(
        lookup.sparkSession.createDataFrame([("alone",)], "k string")
    )
    found = S.left_join_many(cases, fact, ["k"], hot_rows=50)
    plain = cases.join(fact, "k", "left")
    assert sorted(map(str, found.select("k", "id").collect())) == sorted(map(str, plain.collect()))


def test_size_check_counts_rows_and_bytes(spark):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 50, "0").alias("s"))
    assert S.fits_broadcast(df)
    assert not S.fits_broadcast(df, max_rows=99)
    assert not S.fits_broadcast(df, max_bytes=5000)
    assert S.fits_broadcast(df.limit(0))
    assert S.which_fit({"a": df, "b": df.limit(1)}, max_rows=50) == {"a": False, "b": True}


def test_checkpoint_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    before = spark.sparkContext.getCheckpointDir()
    assert S.stored(spark.range(3)).count() == 3
    if named:
        assert spark.sparkContext.getCheckpointDir() == before


def test_stored_parts_are_columnar_and_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(100, numPartitions=2).selectExpr("id", "id * 2 AS twice", "cast(null AS string) AS none")
    kept = S.stored(df.mapInPandas(count, df.schema))
    assert seen.value == 100 and kept.dtypes == df.dtypes
    plan = kept.filter("id > 5").select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan and "none" not in plan.split("ReadSchema")[1]
    assert kept.filter("id > 5").count() == 94
    assert S.stored(df.limit(0)).count() == 0


def test_no_stored_fact_passes_as_row_objects(spark):
    tables = roles.case_tables(spark, "/root/testdata/sf0.001")
    for df in (ttr_percentiles(tables, roles.OPTIONS), resolved_case_metrics(tables, roles.PEOPLE, roles.OPTIONS)):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_every_hot_key_is_found(spark):
    df = spark.range(3_000 * 20).selectExpr("id % 3000 as k", "id")
    assert len(S.hot_key_hashes(df, ["k"], 20)) == 3_000


def broadcasts(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")


def test_a_plan_shares_one_budget(sides):
    fact, lookup = sides
    size = S.size_of(lookup)
    plain = fact.join(lookup, "k", "left")

    def twice(plan_bytes):
        with S.within(S.Budget(plan_bytes=plan_bytes, hot_rows=100)) as budget:
            first = S.lookup_join(fact, lookup, ["k"], size)
            second = S.lookup_join(first.drop("v"), lookup, ["k"], size)
        return second, budget.booked

    both, booked = twice(2 * size.bytes)
    assert broadcasts(both) == 2 and booked == [size, size]
    one, booked = twice(2 * size.bytes - 1)
    assert broadcasts(one) == 1 and booked == [size]
    assert rows(S.lookup_join(fact, lookup, ["k"], size)) == rows(plain)
    assert rows(one) == rows(both)


def test_limits_of_the_options_reach_the_views(spark):
    tables = roles.case_tables(spark, "/root/testdata/sf0.001")
    plan = open_case_metrics(tables, roles.PEOPLE, roles.OPTIONS)
    assert broadcasts(plan) > 5
    few = sum(s.bytes for s in tables.fits.values()) // 2
    less = open_case_metrics(tables, roles.PEOPLE, replace(roles.OPTIONS, plan_broadcast_bytes=few))
    assert 0 < broadcasts(less) < broadcasts(plan)
    none = open_case_metrics(tables, roles.PEOPLE, replace(roles.OPTIONS, broadcast_rows=0, key_filter_words=0))
    assert broadcasts(none) == 0


def test_inner_budgets_join_the_outer_one():
    outer = S.Budget(max_rows=5)
    with S.within(outer), S.within(S.Budget(max_rows=50)) as budget:
        assert budget is outer and S.may_broadcast(S.Size(5, 10)) and not S.may_broadcast(S.Size(6, 10))
    assert outer.booked == [S.Size(5, 10)] and S.Size(6, 10)


def hot_sides(spark):
    """5,000 keys of ten rows each and one of 3,000, with rows and cases that meet nothing."""
    many = spark.range(53_000).selectExpr("if(id < 50000, id % 5000, 7) AS k", "id AS v")
    many = many.unionAll(spark.sql("SELECT cast(null AS bigint) AS k, cast(1 AS bigint) AS v"))
    return spark.range(4_000, 6_000).selectExpr("id AS k"), many.unionAll(spark.range(2).selectExpr("9999 AS k", "id AS v"))


def test_a_plan_does_not_name_many_hot_keys(spark):
    cases, many = hot_sides(spark)
    found = S.left_join_many(cases, many, ["k"], hot_rows=3)
    assert len(found._jdf.queryExecution().logical().toString()) < 20_000
    plain = cases.join(many, "k", "left")
    assert sorted(map(str, found.select("k", "v").collect())) == sorted(map(str, plain.collect()))
    salted = S.salted_left_join(many, cases.withColumn("w", F.lit(1)), ["k"], ["v"], hot_rows=3, salts=4)
    assert len(salted._jdf.queryExecution().logical().toString()) < 20_000
    plain = many.join(cases.withColumn("w", F.lit(1)), "k", "left")
    assert sorted(map(str, salted.select("k", "v", "w").collect())) == sorted(map(str, plain.collect()))


def test_more_hot_keys_than_are_told_apart(spark, monkeypatch):
    cases, many = hot_sides(spark)
    monkeypatch.setattr(S, "LISTED_KEYS", 0)
    monkeypatch.setattr(S, "MOST_HOT_KEYS", 1)
    assert S.find_hot(many, ["k"], 3).count() == 1
    found = S.left_join_many(cases, many, ["k"], hot_rows=3)
    plain = cases.join(many, "k", "left")
    assert sorted(map(str, found.select("k", "v").collect())) == sorted(map(str, plain.collect()))
