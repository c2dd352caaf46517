"""The registered queries and their SQL."""

from __future__ import annotations

from . import changes, documents, findings, grounding, lines, listings, observed, proof, records, shown, summaries, trends

_MODULES = (trends, listings, summaries, documents, records, lines, findings, observed, changes, shown, proof, grounding)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}

__all__ = ["QUERIES", "SQL"]
