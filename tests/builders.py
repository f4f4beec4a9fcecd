"""Small hand-made tables: every column null unless given."""

import datetime as dt

from casemetrics.config.options import Options
from casemetrics.config.people import People
from casemetrics.sources.schemas import SCHEMAS
from casemetrics.sources.tables import CaseTables


def at(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def frame(spark, role, rows):
    schema = SCHEMAS[role]
    known = {f.name for f in schema.fields}
    for row in rows:
        assert set(row) <= known, set(row) - known
    data = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
    return spark.createDataFrame(data, schema)


def tables(spark, **rows):
    return CaseTables(**{role: frame(spark, role, rows.get(role, [])) for role in SCHEMAS})


PEOPLE = People.of(
    [
        ("hr_head", "head", None),
        ("extended_onboarding_manager", "eom", None),
        ("attendance_manager", "att", None),
        ("costa_rica_manager", "crm", None),
        ("india_manager", "inm", None),
        ("india_manager", "inm2", None),
        ("india_group_manager", "inm", None),
        ("seattle_manager", "sea", None),
        ("seattle_assignee", "sam", None),
        ("service_leader", "svc", None),
        ("corporate_leader", "fin", "FINANCE"),
        ("consumer_leader", "shop", None),
    ]
)

OPTIONS = Options(as_of=dt.datetime(2019, 6, 1, 12))
