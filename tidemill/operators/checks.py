"""Data-quality checks; results are small frames (name, severity, passed, value)."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMPARE = {"lt": operator.lt, "lte": operator.le, "eq": operator.eq, "neq": operator.ne, "gte": operator.ge, "gt": operator.gt}
REPORT = "name string, severity string, passed boolean, value double"


class ValidationError(ValueError):
    """Checks of severity error failed."""


def sql_check(spark: SparkSession, check: Mapping[str, Any]) -> tuple[str, str, bool, float]:
    """failing_rows: the query must return none. metric: its scalar compared with threshold by lt, lte, eq, neq, gte or gt."""
    severity = check.get("severity", "error")
    if check["type"] == "failing_rows":
        n = spark.sql(check["sql"]).count()
        return check["name"], severity, n == 0, float(n)
    if check["type"] == "metric":
        row = spark.sql(check["sql"]).first()
        if row is None or row[0] is None:
            raise ValidationError(f"{check['name']}: the metric is null")
        return check["name"], severity, _COMPARE[check["operator"]](row[0], check["threshold"]), float(row[0])
    raise ValueError(f"unknown check {check['type']!r}")


def run_checks(spark: SparkSession, checks: list[Mapping[str, Any]], strict: bool = True) -> DataFrame:
    """Runs all checks, then raises if one of severity error failed (unless not strict)."""
    rows = [sql_check(spark, c) for c in checks]
    if strict and (bad := [r[0] for r in rows if r[1] == "error" and not r[2]]):
        raise ValidationError(f"failed: {', '.join(bad)}")
    return spark.createDataFrame(rows, REPORT)


def group_count(df: DataFrame, by: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """Groups whose row count lies outside [low, high]."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col("rows") < low)
    if high is not None:
        bad = bad | (F.col("rows") > high)
    return out.where(bad)


def group_sum(df: DataFrame, by: list[str], column: str, expected: float, tolerance: float) -> DataFrame:
    """Groups whose sum isn't within the tolerance of what is expected."""
    return df.groupBy(*by).agg(F.sum(column).alias("total")).where(F.abs(F.col("total") - expected) > tolerance)


def column_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows outside the bounds; both count."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return df.where(bad)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of nulls in each column, from one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValidationError(f"missing columns: {', '.join(missing)}")
