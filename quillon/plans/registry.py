"""All queries of the reference's operators by name, and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Modules that register queries when they are imported.
MODULES = ("retrieval", "graph", "answers", "schema", "models", "search", "streams")


def query(sql: str | None = None, name: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def wrap(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return wrap


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"quillon.plans.{m}")
