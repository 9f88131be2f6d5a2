"""All queries of the core and their SQL."""

from __future__ import annotations

from sigtrace.plans import canonical, captures, events, records


def queries() -> dict:
    return records.QUERIES | events.Q | captures.Q | canonical.Q


def oracle_sql() -> dict[str, str]:
    return records.ORACLE | events.SQL | captures.SQL | canonical.SQL
