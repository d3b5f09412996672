"""All queries outside the llm folder, with their SQL."""

from __future__ import annotations

from tallyforge.plans import audit, evidence, lookups, records

_PARTS = (audit, lookups, evidence, records)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
