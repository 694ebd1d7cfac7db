"""Registered queries over the given tables and their DuckDB twins."""

from __future__ import annotations

import importlib

_MODULES = ["path_queries", "language_queries", "history_queries", "content_queries", "report_queries", "extra_queries", "stored_queries"]


def load():
    """(Spark queries, DuckDB queries) by name."""
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    from repoquarry.workload.registry import duckdb_queries, spark_queries

    return spark_queries(), duckdb_queries()
