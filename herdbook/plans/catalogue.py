"""All registered queries of the core and their SQL."""

from __future__ import annotations

from herdbook.plans import columns, dealt, survey

QUERIES = dealt.QUERIES | survey.QUERIES | columns.QUERIES
SQL = dealt.SQL | survey.SQL | columns.SQL
