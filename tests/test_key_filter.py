"""The filter of case ids below the reductions of the trail."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from casemetrics.operators.key_filter import key_filter, may_hold, of_keys
from casemetrics.plans.views import open_case_metrics
from casemetrics.sources.tables import CaseTables
from workload import roles


def ids(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("c"), "id").alias("case_id"))


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 20_000])
def test_every_key_passes_and_few_others(spark, n):
    keys = ids(spark, 0, n)
    assert of_keys(ids(spark, 0, n), "case_id", keys).count() == n
    others = of_keys(ids(spark, 10**6, 10**6 + 20_000), "case_id", keys).count()
    assert others <= 20_000 * 0.03


def test_size_follows_the_keys_up_to_the_bound(spark):
    def words(n, most):
        return len(key_filter(ids(spark, 0, n), "case_id", most).first().words)

    assert words(1000, 1 << 20) == 256 and words(5000, 1 << 20) == 2048
    assert words(5000, 512) == 512 and words(10_000, 512) == 0
    rows = ids(spark, 0, 50)
    assert of_keys(rows, "case_id", ids(spark, 0, 10_000), 512).count() == 50
    assert of_keys(rows, "case_id", ids(spark, 0, 10), 0).count() == 50


def test_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "case_id string")
    assert sorted(r.case_id for r in of_keys(rows, "case_id", rows).collect()) == ["a", "a", "b"]
    empty = rows.filter("false")
    assert of_keys(rows, "case_id", empty).count() == 0
    words = key_filter(empty, "case_id").scalar()
    assert rows.filter(may_hold(words, "case_id")).count() == 0


def shuffled_cases(df):
    """Rows that the exchanges of the trail's reduction by case wrote, after a run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.nodeName() == "Exchange":
            below = node.toString()
            if "sum" in below.split("\n")[1] and "HashAggregate(keys=[case_id" in below.split("\n")[1]:
                metric = node.metrics().get("shuffleRecordsWritten")
                if metric.isDefined():
                    found.append(metric.get().value())
        children = node.children()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_only_cases_in_scope_are_aggregated(spark):
    """Rows that enter the shuffle of the open view's trail, with and without the filter."""
    folder = "/root/testdata/sf0.001"
    given = {name: roles.role(spark, folder, name) for name in roles.ROLE_SQL}
    tables = CaseTables.of(**given)
    with_filter = open_case_metrics(tables, roles.PEOPLE, roles.OPTIONS)
    without = open_case_metrics(tables, roles.PEOPLE, replace(roles.OPTIONS, key_filter_words=0))
    few, all_cases = shuffled_cases(with_filter), shuffled_cases(without)
    assert len(few) == len(all_cases) == 1
    assert 0 < few[0] < all_cases[0] / 2
    assert sorted(map(str, with_filter.collect())) == sorted(map(str, without.collect()))


def test_no_action_while_the_filter_is_built(spark):
    """The words are a scalar subquery of the plan, so later rows of the tables are seen."""
    keys = ids(spark, 0, 3)
    plan = of_keys(ids(spark, 0, 9), "case_id", keys)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search("scalar-subquery", plan)
