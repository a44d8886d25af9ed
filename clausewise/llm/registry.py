"""All queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

from . import queries_corpus, queries_mining, queries_pages, queries_rows

MODULES = (queries_rows, queries_corpus, queries_pages, queries_mining)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
