"""Every registered query of the risk operators, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from ripplemark.plans import article_queries, event_queries, graph_queries


def _all() -> dict[str, tuple]:
    return event_queries.Q | article_queries.Q | graph_queries.Q


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
