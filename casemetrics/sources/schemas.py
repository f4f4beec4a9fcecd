"""Column types of the ten input tables and of the people table."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}


def _schema(**groups: str) -> T.StructType:
    fields = []
    for type_name, names in groups.items():
        fields += [T.StructField(name, _TYPES[type_name]) for name in names.split()]
    return T.StructType(fields)


TICKETS = _schema(
    string="case_id assigned_to_group category type item status requester_login submitted_by "
    "assigned_to_individual resolved_by last_modified_by root_cause root_cause_details resolution "
    "closure_code",
    int="impact",
    date="create_day",
    timestamp="create_date resolved_date modified_date assigned_date dw_last_updated",
)

AUDIT = _schema(
    string="case_id description from_string to_string created_by assigned_to",
    int="type",
    date="create_day",
    timestamp="modified_date create_date",
)

HEADCOUNT = _schema(
    string="employee_login department_name department_id company_country_code job_title_name "
    "job_level_name department_org_level1 department_org_level2 "
    "reports_to_supervisor_employee_name "
    + " ".join(f"reports_to_level_{n}_employee_login" for n in range(2, 10)),
    timestamp="hr_begin_dt",
)

CONCERNED = _schema(string="ticket_case_id concerning_login", timestamp="create_date")

GROUPS = _schema(
    string="resolver_group hrsd location super_region country delivery_group dash_process "
    "sla_target_exists defect_scope",
    int="report_switch days_week sla_target",
    timestamp="defect_launch",
)

ROOT_CAUSES = _schema(string="root_cause root_cause_group")

CTI_PROCESS = _schema(string="category type country global_process")

CTI_SLAS = _schema(string="category type item", int="sla_target")

DEFAULT_HUBS = _schema(
    string="category type item resolver_group default_hub def_hub_group", int="sla_target"
)

TRANSACTIONS = _schema(string="assigned_to_group category type item grouping transaction_type")

PEOPLE = _schema(string="role login label")

SCHEMAS = {
    "tickets": TICKETS,
    "audit": AUDIT,
    "headcount": HEADCOUNT,
    "concerned": CONCERNED,
    "groups": GROUPS,
    "root_causes": ROOT_CAUSES,
    "cti_process": CTI_PROCESS,
    "cti_slas": CTI_SLAS,
    "default_hubs": DEFAULT_HUBS,
    "transactions": TRANSACTIONS,
}
