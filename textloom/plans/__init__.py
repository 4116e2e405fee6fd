"""Queries of the operators over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable


def _modules() -> list:
    from textloom.plans import analytics, books, dictionary, documents, joins, numerals, overrides, reading, spans, text

    return [analytics, dictionary, joins, spans, numerals, text, documents, overrides, books, reading]


def queries() -> dict[str, Callable]:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
