import datetime as dt

from casemetrics.plans.case_frame import case_frame
from tests.builders import OPTIONS, PEOPLE, tables
from workload.roles import GIVEN, FrameRoles, RoleTables


def test_frames_derive_the_tickets_once(spark, tmp_path):
    day = dt.datetime(1996, 1, 2)
    orders = [(k, k * 3, "FOP"[k % 3], day, "1-URGENT") for k in (1, 2, 2, 3, 9)] + [(None, 1, None, day, None)]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame([(1, day), (2, day), (2, None)], "l_orderkey long, l_shipdate timestamp_ntz")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in set(GIVEN) - {"orders", "lineitem"}:
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    plain, kept = RoleTables(spark, str(tmp_path)).tickets, FrameRoles(spark, str(tmp_path))
    assert kept.tickets is kept.tickets and kept.tickets.dtypes == plain.dtypes
    plan = kept.tickets._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(str, kept.tickets.collect())) == sorted(map(str, plain.collect()))


def test_long_methods_run_operator_by_operator(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    case_frame(tables(spark), PEOPLE, OPTIONS, True, [])
    assert int(spark.conf.get(limit)) <= 8000
