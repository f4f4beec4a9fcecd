"""Settings of the case plans."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemetrics.operators.key_filter import KEY_FILTER_WORDS
from casemetrics.operators.percentiles import HOT_GROUP_ROWS
from casemetrics.operators.sizing import HOT_KEY_ROWS, PLAN_BROADCAST_BYTES, Budget
from casemetrics.config import fixed_values as V
from casemetrics.config.values import RuleValues


def _dates() -> dict[str, str]:
    return {
        "audit_from": V.AUDIT_FROM,
        "correspondence_from": V.CORRESPONDENCE_FROM,
        "concerned_from": V.CONCERNED_FROM,
        "open_cases_from": V.OPEN_CASES_FROM,
        "resolved_cases_from": V.RESOLVED_CASES_FROM,
        "percentiles_from": V.PERCENTILES_FROM,
        "routing_from": V.ROUTING_FROM,
        "marks_from": V.MARKS_FROM,
    }


@dataclass(frozen=True)
class Options:
    """``as_of`` stands for the run time; by default it is the time the query starts.

    ``created_on_day`` states that ``create_day`` of the audit trail is the day of ``create_date``.
    Cut-offs by time then also cut by day, which prunes a trail stored by ``create_day``.
    ``key_filter_words`` bounds the filter of case ids that spares the trail of other cases; 0 is off.
    ``rule_values`` take the place of fixed values in the rules.
    ``broadcast_rows`` and ``broadcast_bytes`` bound a side that is broadcast, ``plan_broadcast_bytes``
    all of a plan; ``hot_rows`` are the rows from which a key is spread over several tasks.
    """

    dates: dict[str, str] = field(default_factory=_dates)
    scope: tuple[str, ...] = (V.BENEFITS,)
    as_of: dt.datetime | None = None
    source_zone: str = "UTC"
    hot_rows: int = HOT_KEY_ROWS
    broadcast_rows: int | None = None
    broadcast_bytes: int | None = None
    plan_broadcast_bytes: int = PLAN_BROADCAST_BYTES
    hot_group_rows: int = HOT_GROUP_ROWS
    created_on_day: bool = False
    key_filter_words: int = KEY_FILTER_WORDS
    rule_values: RuleValues = field(default_factory=RuleValues)

    def budget(self) -> Budget:
        """Limits of one plan, with nothing booked."""
        return Budget(self.broadcast_rows, self.broadcast_bytes, self.plan_broadcast_bytes, self.hot_rows)

    def date(self, name: str) -> Column:
        return F.lit(self.dates[name]).cast("date")

    def timestamp(self, name: str) -> Column:
        return F.lit(self.dates[name]).cast("timestamp_ntz")

    def created_since(self, name: str) -> Column:
        """Whether an audit event is not older than a cut-off."""
        recent = F.col("create_date") >= self.timestamp(name)
        return recent & (F.col("create_day") >= self.date(name)) if self.created_on_day else recent

    def run_time(self) -> Column:
        return F.localtimestamp() if self.as_of is None else F.lit(str(self.as_of)).cast("timestamp_ntz")

    def covers(self, process: str) -> bool:
        return process.lower() in self.processes()

    def processes(self) -> list[str]:
        return [name.lower() for name in self.scope]
