"""All queries of the corpus operators, each with the SQL that DuckDB answers alike where there is such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.plans.views import Tables
from quillmill.runtime import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(tables) as a query, with its SQL twin."""

    def deco(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return deco


def load() -> None:
    from quillmill.plans import (  # noqa: F401
        aggregate_queries, dml_queries, extra_queries, match_queries, more_queries, ordered_queries, pipeline_queries, read_queries, scalar_queries, source_queries, stream_queries, write_queries,
    )
