"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: DuckDB SQL by query; queries without are checked by unit tests.
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of a reader of tables under its name."""
    def add(fn: Callable[..., DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add
