"""Sinks: single and partitioned outputs, replace and append, formats, skipping, run logs."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import ordering
from tidemill.sources.scratch import path_exists
from tidemill.sources.snapshots import SnapshotTable


def write_output(df: DataFrame, path: str, fmt: str = "parquet", sort_by: list[str] | None = None, mode: str = "overwrite", gzip: bool = False) -> None:
    """One relation as parquet, csv (with header) or jsonl."""
    if sort_by:
        df = df.orderBy(*ordering(sort_by))
    writer = df.write.mode(mode)
    if gzip:
        writer = writer.option("compression", "gzip")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_partitioned(df: DataFrame, path: str, by: str | None = None, expression: str | None = None, column: str | None = None, mode: str = "replace_partition", sort_by: list[str] | None = None, atomic: bool = False) -> None:
    """Partitioned parquet: replace_partition rewrites only the partitions that df has rows of, append adds files.

    atomic: the partitions are replaced by one commit to a snapshot table, so that no reader and no crash comes in between.
    The rebalancing by partition lets Spark split a partition that holds most of the rows.
    """
    if expression and not column:
        raise ValueError("a partition expression needs a column name")
    if expression:
        df, by = df.withColumn(column, F.expr(expression)), column
    if mode not in ("replace_partition", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if atomic and mode == "replace_partition":
        t = SnapshotTable(df.sparkSession, path, partition=by)
        t.adopt()
        t.replace_units(df, sort_by)
        return
    df = df.hint("rebalance", by)
    df = df.sortWithinPartitions(F.col(by), *(ordering(sort_by) if sort_by else []))
    writer = df.write.partitionBy(by)
    if mode == "append":
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_if_missing(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Writes unless a finished output is there; says whether it wrote."""
    if path_exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    write_output(df, path, fmt)
    return True


def with_ingest_date(df: DataFrame, mode: str, value: Any = None, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Adds dt: today, a literal, a parameter's value or a column's."""
    if mode == "today":
        c = F.current_date()
    elif mode == "literal":
        c = F.lit(value).cast("date")
    elif mode == "parameter":
        c = F.lit((params or {})[value]).cast("date")
    elif mode == "column":
        c = F.col(value).cast("date")
    else:
        raise ValueError(f"unknown ingest date mode {mode!r}")
    return df.withColumn("dt", c)


def append_events(spark: SparkSession, path: str, events: list[Mapping[str, Any]]) -> None:
    """Appends run events (workflow, run_id, event_type, phase, status, rows, details) to a log table."""
    schema = "workflow string, run_id string, event_type string, phase string, status string, rows bigint, details string"
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(e.get(n) for n in names) for e in events], schema).write.mode("append").parquet(path)
