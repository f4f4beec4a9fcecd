"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__
from casemetrics.config.people import People
from casemetrics.operators import sizing
from casemetrics.plans.views import open_case_metrics
from casemetrics.sources import publish_table, publish_view, read_tables
from casemetrics.sources.schemas import SCHEMAS
from casemetrics.sources.tables import conform
from workload import roles
from workload.check import compare, database
from workload.registry import REGISTRY, Entry, tidy

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


NAMES = list(REGISTRY)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    problem = compare(spark, connection, FOLDER, name)
    assert problem is None or problem == "no rows", problem


def test_contract(spark):
    assert set(REGISTRY) <= set(__spark_entry__.queries()) & set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0


def test_sources_and_sinks(spark, tmp_path):
    given = roles.case_tables(spark, FOLDER)
    for name in SCHEMAS:
        publish_table(getattr(given, name), str(tmp_path / name))
    again = read_tables(spark, {name: str(tmp_path / name) for name in SCHEMAS})
    assert again.tickets.count() == given.tickets.count()
    days = publish_table(given.audit, str(tmp_path / "by_day"), partition_by="create_day")
    assert days.count() == given.audit.count()
    assert publish_view(again.groups, "published_groups").count() == 25
    from_catalogue = {**{n: str(tmp_path / n) for n in SCHEMAS}, "groups": "published_groups"}
    assert read_tables(spark, from_catalogue).groups.count() == 25


def test_conform_reads_event_types_from_text(spark):
    others = [f for f in SCHEMAS["audit"].fields if f.name != "type"]
    columns = ", ".join(f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in others)
    df = spark.sql(f"select {columns}, explode(array('261', 'x')) as type")
    assert [r.type for r in conform(df, "audit").collect()] == [261, None]
    with pytest.raises(ValueError, match="case_id"):
        conform(df.drop("case_id"), "audit")


def test_conform_refuses_unreadable_dates(spark):
    others = [f for f in SCHEMAS["tickets"].fields if f.name != "create_date"]
    columns = ", ".join(f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in others)
    with pytest.raises(Exception, match="no date"):
        conform(spark.sql(f"select {columns}, 'no date' as create_date"), "tickets").collect()


def test_views_without_any_broadcast(spark, connection, monkeypatch):
    """The same result when no lookup passes the size check."""
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", -1)
    name = "k1_open_case_metrics"
    entry = REGISTRY[name]

    def run(session, folder):
        tables = roles.case_tables(session, folder)
        assert not any(tables.fits.values())
        return tidy(open_case_metrics(tables, roles.PEOPLE, roles.OPTIONS))

    monkeypatch.setitem(REGISTRY, name, Entry(run, entry.sql))
    assert compare(spark, connection, FOLDER, name) is None


def test_people_come_from_a_table(spark):
    df = spark.createDataFrame(
        [("hr_head", "h", None), ("corporate_leader", "c", "LINE")], "role string, login string, label string"
    )
    assert People.from_table(df).managers("hr_head") == ["H"]
    many = spark.range(10_001).selectExpr("'hr_head' role", "concat('m', id) login", "cast(null as string) label")
    assert len(People.from_table(many).managers("hr_head")) == 10_001
    with pytest.raises(ValueError, match="unknown"):
        People.of([("nobody", "x", None)])
    with pytest.raises(ValueError, match="label"):
        People.of([("corporate_leader", "x", None)])
