"""Queries of the training-data problems (p2 to p10) and, where SQL can express one, its SQL."""

from __future__ import annotations

from herdbook.llm import q_match, q_text

QUERIES = q_text.QUERIES | q_match.QUERIES
SQL = q_text.SQL | q_match.SQL
