"""The registry of queries: a callable (spark, sf_dir) for each name, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with times that have no zone as timestamps of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [n for n, k in df.dtypes if k == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in ntz}) if ntz else df
