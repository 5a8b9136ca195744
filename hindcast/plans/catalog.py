"""All queries of the library by name, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from . import audits, governance, kernels, metrics, models, ranking, relational, rounds, studies, transport, verification

PARTS = (metrics, relational, ranking, governance, models, kernels, rounds, studies, transport, verification, audits)


def queries() -> dict:
    return {name: query for part in PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
