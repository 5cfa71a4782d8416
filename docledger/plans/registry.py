"""Registry of runnable queries and their oracle SQL."""
from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
MODULES = ("identity", "library", "classify", "materials", "operations", "evaluation", "pages", "quantities", "approval", "reviews", "streams", "flagship", "roundtrips")


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn
    return register


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"docledger.plans.{module}")
    return REGISTRY
