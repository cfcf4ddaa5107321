"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from .plans import analytics, files, graphs, ingests, names, serving  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
