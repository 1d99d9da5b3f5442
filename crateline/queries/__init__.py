"""Registered queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("catalogue", "keys", "text", "tags", "filters", "neighbours", "playlists", "duplicates", "segments", "audit", "sequences", "sync", "streams")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
