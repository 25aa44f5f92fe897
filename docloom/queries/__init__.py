"""Registered queries over the driver tables, and SQL that gives the same rows."""

from __future__ import annotations

from docloom.queries import catalog, details, lifecycle, parsing, retrieval, sequence, service, similar, stored


def _parts():
    return (catalog, lifecycle, sequence, retrieval, parsing, service, details, similar, stored)


def queries() -> dict:
    return {name: f for part in _parts() for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.SQL.items()}
