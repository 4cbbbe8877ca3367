"""Registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from lumenrow.plans import documents, landed, names, reports, timelines

QUERIES = dict(sorted((reports.QUERIES | timelines.QUERIES | documents.QUERIES | landed.QUERIES | names.QUERIES).items()))
ORACLES = reports.ORACLES | timelines.ORACLES | documents.ORACLES | landed.ORACLES | names.ORACLES
