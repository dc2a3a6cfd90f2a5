"""All queries by name, with their SQL."""

from __future__ import annotations

from . import case_queries, handover_queries, intake_queries, question_queries, report_queries, stream_queries, text_queries, triage_queries

_PARTS = (triage_queries, intake_queries, text_queries, case_queries, handover_queries, stream_queries, question_queries, report_queries)

QUERIES: dict = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES: dict = {k: s for part in _PARTS for k, s in part.SQL.items()}
