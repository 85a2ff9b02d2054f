"""Every query of the core library by name, with its DuckDB twin."""

from __future__ import annotations

from .plans import pair_queries, registry, store_queries, text_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
