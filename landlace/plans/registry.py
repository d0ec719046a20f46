"""Registered queries with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landlace.plans.fixtures import ctes, part
from landlace.workers import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(*parts: str, sql: str | None = None, more: str = ""):
    """Register a function of the named parts; sql is the body that follows their common table expressions, `more` further ones."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(*[part(spark, sf_dir, p) for p in parts])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            names = [p for p in parts]
            head = ctes(*names) if names else ""
            ORACLES[f.__name__] = head + (f",\n{more}" if more and head else f"with {more}" if more else "") + "\n" + sql
        return f

    return register


def table_query(*tables: str, sql: str | None = None):
    """Register a function of whole driver tables."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
