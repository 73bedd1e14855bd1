"""All queries of the reference's operators, and their SQL.

A query is a function (spark, sf_dir) -> DataFrame registered under a name, with the DuckDB
statement that gives the same rows, or None where SQL can't.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("corpus", "catalogue", "training", "metrics", "files")


class Book:
    """Queries and statements of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None, longs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """longs: columns that Spark has as int and the statement as a 64-bit number."""

        def put(f: Query) -> Query:
            def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                return df.withColumns({c: df[c].cast("long") for c in longs})

            self.queries[f.__name__] = widened if longs else f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def _books() -> list[Book]:
    return [import_module(f"spindle.plans.{m}").book for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: v for b in _books() for k, v in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for b in _books() for k, v in b.sql.items()}
