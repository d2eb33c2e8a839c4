"""All queries of the package by name, with the SQL that checks them and the operators they show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "lead_lag"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Inventory numbers by query.
SHOWS: dict[str, str] = {}


def query(shows: str, sql: str | None = None):
    """Registers a function as a query under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        SHOWS[f.__name__] = shows
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from tephra.plans import q_events, q_grid, q_models, q_series, q_sources, q_statistics  # noqa: F401


load()
