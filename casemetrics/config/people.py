"""Named people that rules depend on, read from a table instead of written into code."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.config.values import V
from casemetrics.operators.rules import first_match

ROLES = {
    "hr_head": "level-2 manager over the staff who handle cases",
    "extended_onboarding_manager": "level-5 manager whose requests have no extended-onboarding SLA",
    "attendance_manager": "level-7 manager whose submissions have no attendance SLA",
    "costa_rica_manager": "level-6 manager in Costa Rica",
    "india_manager": "level-6 manager in India, for the delivery location",
    "india_group_manager": "level-6 manager in India, for the delivery group",
    "seattle_manager": "level-5 manager in Seattle",
    "seattle_assignee": "person in Seattle, spelled as in the tickets",
    "service_leader": "level-5 manager of customer service",
    "corporate_leader": "level-2 manager of a corporate line; the label is the line",
    "consumer_leader": "level-2 manager of the consumer line",
}


@dataclass(frozen=True)
class People:
    """Logins by role; manager logins are compared in upper case."""

    entries: tuple[tuple[str, str, str | None], ...]

    @classmethod
    def of(cls, entries: Iterable[tuple[str, str, str | None]]) -> People:
        rows = tuple((role, login, label) for role, login, label in entries)
        unknown = {role for role, _, _ in rows} - set(ROLES)
        if unknown:
            raise ValueError(f"unknown roles {sorted(unknown)}")
        if any(role == "corporate_leader" and not label for role, _, label in rows):
            raise ValueError("a corporate_leader needs a label")
        return cls(rows)

    @classmethod
    def from_table(cls, df: DataFrame) -> People:
        """All entries; the table lists people that rules name, so it does not grow with the cases."""
        return cls.of(tuple(row) for row in df.select("role", "login", "label").distinct().collect())

    def logins(self, role: str) -> list[str]:
        return [login for r, login, _ in self.entries if r == role]

    def managers(self, role: str) -> list[str]:
        return [login.upper() for login in self.logins(role)]

    def is_in(self, column: Column, role: str) -> Column:
        """True for a manager of the role; never true for a role without people."""
        return column.isin(self.managers(role)) if self.managers(role) else F.lit(False)

    def line_of_business(self, level2: Column, level5: Column, department: Column) -> Column:
        """Detailed line of one person, null when no rule claims the person."""
        lines = {login.upper(): label for r, login, label in self.entries if r == "corporate_leader"}
        consumer = self.is_in(level2, "consumer_leader") & (department != V.OPERATIONS_DEPARTMENT)
        return first_match(
            [
                (self.is_in(level5, "service_leader"), V.SERVICE_LINE),
                *[(level2 == login, label) for login, label in lines.items()],
                (consumer, V.CONSUMER_LINE),
            ]
        )


def broad_line(line: Column) -> Column:
    """Service stays itself, every other known line is corporate; null stays null."""
    return F.when(line == V.SERVICE_LINE, line).when(line.isNotNull(), V.CORPORATE_LINE)
