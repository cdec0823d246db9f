"""Register a query together with the SQL that states the same result independently."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: ``fn(spark, sf_dir)`` becomes the query ``name``; ``sql`` runs in DuckDB on the same tables."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times of the tables carry no zone and are declared UTC; a session in another zone would shift them.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap
