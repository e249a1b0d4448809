"""All queries of the library's operators by name, with their SQL."""

from __future__ import annotations

from tidewell.plans import aggregates, analytics, code, extras, further, graphs, memory, more, ranges, search, sinks, streams, texts  # noqa: F401  (each registers its queries)
from tidewell.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
