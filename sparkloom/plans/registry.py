"""Where queries over the driver tables, and their SQL oracles, are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, source: str | tuple[str, ...], sql: str | None = None):
    """Register a function of tables as a query, with its oracle where SQL can express it."""
    names = (source,) if isinstance(source, str) else source

    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(*[table(spark, sf_dir, t) for t in names])
        if sql:
            ORACLE[name] = sql
        return fn

    return register
