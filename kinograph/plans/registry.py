"""Where plan modules register their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable) -> Callable:
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register
