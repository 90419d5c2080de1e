"""All registered queries of the timeline engine, gathered from the plan modules."""

from __future__ import annotations

from kinograph.plans import containers, editing, frames, joins, pixels, sequences, signals, texts  # noqa: F401  (they register their queries)
from kinograph.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
