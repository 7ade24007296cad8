"""All queries by name, with the SQL that states the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLANS = ("texts", "segments", "layout", "relations", "memory", "checks", "exchange", "operations", "books", "editorial")


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query under its function's name, and the DuckDB SQL that it must equal."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return register


for _plan in PLANS:
    importlib.import_module(f"quillspark.plans.{_plan}")
