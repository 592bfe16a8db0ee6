"""Every core query by name, and the SQL that says what it returns."""

from __future__ import annotations

from aforo.plans import audit, detectors, ensemble, flows, inference, learned, monthly, reports, spatial, validation, welfare

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (monthly, flows, ensemble, spatial, detectors, reports, welfare, learned, audit, validation, inference):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
