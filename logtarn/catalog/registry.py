"""The list of queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logtarn.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def catalogued(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(function):
        key = name or function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__name__ = key
        run.__doc__ = function.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register
