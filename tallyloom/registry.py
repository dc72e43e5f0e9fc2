"""Queries and oracle SQL of the engine's own operators, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from tallyloom.plans import content, exchange, indexes, labels, learning, lists, parsers, resuming, streams

MODULES = (learning, content, labels, lists, parsers, resuming, streams, exchange, indexes)


def queries() -> dict[str, Callable]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
