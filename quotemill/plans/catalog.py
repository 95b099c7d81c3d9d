"""Registered queries and their SQL: importing a module of queries registers them."""

from __future__ import annotations

from quotemill.plans import analytics, core, feeds, studies  # noqa: F401
from quotemill.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
