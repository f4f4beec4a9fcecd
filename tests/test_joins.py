from tests.builders import at, tables
from workload import joins  # noqa: F401  registers the query
from workload.registry import REGISTRY


def test_last_mark_of_every_case(spark):
    """Marks of open cases and marks before the cut-offs count as well."""
    given = tables(
        spark,
        tickets=[{"case_id": c, "status": "Assigned"} for c in ("old", "two", "none")],
        audit=[
            {"case_id": "old", "type": 261, "to_string": "a", "modified_date": at("1990-01-01")},
            {"case_id": "two", "type": 261, "to_string": "b", "modified_date": at("1990-01-01")},
            {"case_id": "two", "type": 261, "to_string": "c", "modified_date": at("1990-01-02")},
            {"case_id": "none", "type": 10, "to_string": "d", "modified_date": at("1990-01-02")},
        ],
    )
    found = REGISTRY["c5_join_top_row"].build(given).collect()
    assert {r.case_id: r.root_cause_tag for r in found} == {"old": "a", "two": "c", "none": None}
