"""All registered queries of the core and their DuckDB oracles."""

from __future__ import annotations

from tallyard.plans import audit, runlog, scoring, views

QUERIES: dict = {} | audit.QUERIES | runlog.QUERIES | views.QUERIES | scoring.QUERIES
ORACLES: dict[str, str] = {} | audit.ORACLES | runlog.ORACLES | views.ORACLES | scoring.ORACLES
