"""Registered queries of the graph engine."""

from __future__ import annotations

from .plans import catalogue, code, service, views  # noqa: F401  each adds its queries to the catalogue


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.SQL)
