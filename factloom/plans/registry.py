"""A query is registered under the operator's id with the SQL that gives the same rows, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``run(t)``, t giving tables and adapter views by name."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: run(adapters.Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = adapters.with_views(sql, adapters.VIEWS)
        return run

    return add


def both(name: str, sql: str) -> None:
    """Registers one SQL text that both engines run."""
    QUERIES[name] = lambda spark, sf_dir: adapters.Tables(spark, sf_dir).sql(sql)
    SQL[name] = adapters.with_views(sql, adapters.VIEWS)
