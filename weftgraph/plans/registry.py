"""Registry of queries: name, Spark function, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weftgraph.plans.views import Tables, with_views

FUNCTIONS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **extra: str):
    """Register a query on Tables; sql may name the shared tables and those in `extra`."""

    def add(f: Callable[[Tables], DataFrame]):
        FUNCTIONS[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return f

    return add


def queries() -> dict:
    return {n: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for n, f in FUNCTIONS.items()}
