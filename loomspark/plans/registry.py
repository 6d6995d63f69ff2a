"""The recorded queries by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "calendar_anomaly"


def recorded(oracle_sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function (spark, folder) under its name, with DuckDB SQL for its rows if SQL can express them."""
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle_sql is not None:
            ORACLES[f.__name__] = oracle_sql
        return f

    return put


def load() -> None:
    """Import every module that records queries."""
    from importlib import import_module

    for name in ("findings", "star", "kernel_queries", "texts", "upkeep", "pages", "links", "cases", "files"):
        import_module(f"loomspark.plans.{name}")
