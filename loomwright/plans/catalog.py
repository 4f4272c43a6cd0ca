"""Where query modules put their queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name; sql is its DuckDB oracle, where SQL can say it."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder; spread: for work that is heavy by row, deal it out where it has fewer splits than there are cores.

    A table that large clusters are for has far more splits than that, and is read as it lies.
    """
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if spread and found.rdd.getNumPartitions() < cores else found
