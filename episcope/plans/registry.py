"""The list of registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from episcope.plans.views import Tables, sql_with


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, views: str = "", sql: str | None = None, extra: str = "", name: str | None = None):
    """Register a function of ``Tables``; ``covers`` lists the inventory entries it shows."""

    def register(run: Callable[[Tables], DataFrame]):
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(key, covers, run, None if sql is None else sql_with(views, sql, extra))
        return run

    return register
