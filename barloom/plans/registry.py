"""Query registry: a Spark callable, the SQL it must equal, and what it covers."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}
MODULES = ("scans", "gates", "indicators", "signals", "trades", "portfolio", "studies",
           "fundamental", "feeds", "streams")


def query(covers: str, sql: str | None = None):
    """Register a function under its own name; ``covers`` lists survey rows."""
    def add(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        QUERIES[fn.__name__] = Query(fn.__name__, fn, sql, tuple(covers.split()))
        return fn
    return add


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"barloom.plans.{m}")
    return QUERIES
