"""Dated tables: ingestion with a log, status, compaction into monthly files; rollups through tiers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import auto_numeric, null_markers
from tidemill.operators.dataset import build_dataset
from tidemill.operators.steps import run_step
from tidemill.sources.readers import read_files
from tidemill.sources.scratch import has_partitions, path_exists, remove_path, stored
from tidemill.sources.writers import write_output, write_partitioned

LOG = "table string, kind string, period string, rows bigint, status string, seq bigint"


class RollupError(ValueError):
    """A rollup's inputs aren't what they should be."""


class DatedTable:
    """A table of daily partitions, monthly ones beside them, and a log of what was done.

    The log decides where a day is read from: from the daily tier if its last ingestion came after its
    month's last compaction, else from the monthly one. So late days and days that are ingested anew are
    seen at once, and a later compaction merges them into the month.
    """

    def __init__(self, spark: SparkSession, name: str, base: str, dataset: Mapping[str, Any] | None = None, date_format: str = "yyyy-MM-dd") -> None:
        self.spark, self.name, self.dataset, self.date_format = spark, name, dataset, date_format
        self.daily, self.monthly, self.logs = f"{base}/daily", f"{base}/monthly", f"{base}/log"

    def _now(self) -> int:
        return int(dt.datetime.now(dt.timezone.utc).timestamp() * 1e6)

    def _log(self, kind: str, period: str, rows: int | None, status: str, seq: int | None = None) -> None:
        self.spark.createDataFrame([(self.name, kind, period, rows, status, seq or self._now())], LOG).coalesce(1).write.mode("append").parquet(self.logs)

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.logs)

    def log(self) -> DataFrame:
        """The latest entry of each period and kind."""
        w = Window.partitionBy("table", "kind", "period").orderBy(F.desc("seq"))
        return self._entries().withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")

    def _put_days(self, rows: DataFrame) -> None:
        """Replaces the days of rows; a day's folder is dt=<date in the table's format>."""
        named = rows.withColumn("dt", F.date_format("dt", self.date_format))
        write_partitioned(named, self.daily, by="dt")

    def _days(self) -> DataFrame:
        return self.spark.read.parquet(self.daily).withColumn("dt", F.to_date(F.col("dt").cast("string"), self.date_format))

    def _drop_day(self, day: str) -> None:
        name = self.spark.range(1).select(F.date_format(F.lit(day).cast("date"), self.date_format)).first()[0]
        remove_path(self.spark, f"{self.daily}/dt={name}")

    def ingest(self, df: DataFrame, date: str) -> int:
        """Cleans and writes the rows of a date, replacing what that date had, also by nothing."""
        try:
            rows = (build_dataset(df, self.dataset) if self.dataset else df).withColumn("dt", F.lit(date).cast("date"))
            if rows.isEmpty():
                self._drop_day(date)
                n = 0
            else:
                self._put_days(rows)
                n = self._days().where(F.col("dt") == F.lit(date).cast("date")).count()
        except Exception:
            self._log("ingest", date, None, "failed")
            raise
        self._log("ingest", date, n, "success")
        return n

    def ingest_from(self, source: Callable[..., DataFrame], date: str, **params: Any) -> int:
        """Ingests what a source function returns for a date; it gets the date and those of the parameters that it takes."""
        return self.ingest(run_step(source, {"spark": self.spark, "date": date, **params}), date)

    def ingest_all(self, df: DataFrame, date_column: str) -> None:
        """Ingests many dates in one job; each date is replaced and logged."""
        rows = build_dataset(df, self.dataset) if self.dataset else df
        self._put_days(rows.withColumn("dt", F.col(date_column).cast("date")))
        counts = rows.groupBy(F.col(date_column).cast("date").cast("string").alias("period")).agg(F.count(F.lit(1)).alias("rows"))
        counts.select(F.lit(self.name).alias("table"), F.lit("ingest").alias("kind"), "period", "rows", F.lit("success").alias("status"), F.lit(self._now()).alias("seq")).write.mode("append").parquet(self.logs)

    def _fresh(self, upto: int | None = None) -> DataFrame:
        """__fresh: the days that were last ingested after their month's last compaction (and not after `upto`)."""
        ok = self._entries().where("status = 'success'")
        ok = ok.where(F.col("seq") <= upto) if upto else ok
        days = ok.where("kind = 'ingest'").groupBy("period").agg(F.max("seq").alias("seq"))
        months = ok.where("kind = 'compact'").groupBy(F.col("period").alias("month")).agg(F.max("seq").alias("done"))
        return days.join(months, F.substring("period", 1, 7) == F.col("month"), "left").where("done is null or seq > done").select(F.col("period").cast("date").alias("__fresh"))

    def compact(self, month: str, delete: bool = False) -> int:
        """Merges the month's days that no compaction has taken yet into its monthly partition, and returns its rows; with delete, their daily files go afterwards.

        Days that are ingested meanwhile stay daily ones.
        """
        began = self._now()
        fresh = stored(self._fresh(began).where(F.date_format("__fresh", "yyyy-MM") == month), "fresh-days")
        old = self.spark.read.parquet(self.monthly).where(F.col("month") == month).drop("month") if has_partitions(self.spark, self.monthly, "month") else None
        if fresh.isEmpty():
            n = old.count() if old is not None else 0
            if not n:
                raise RollupError(f"{self.name} has no days in {month}")
        else:
            parts = [self._days().join(fresh, F.col("dt") == F.col("__fresh"), "left_semi")] if has_partitions(self.spark, self.daily, "dt") else []
            if old is not None:
                parts.append(old.join(fresh, F.col("dt") == F.col("__fresh"), "left_anti"))
            rows = stored(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), "month")  # read again, and Spark can't overwrite what it reads
            n = rows.count()
            if n:
                write_partitioned(rows.withColumn("month", F.lit(month)), self.monthly, by="month")
            else:
                remove_path(self.spark, f"{self.monthly}/month={month}")
            self._log("compact", month, n, "success", began)
        if delete and has_partitions(self.spark, self.daily, "dt"):
            taken = self._days().where(F.date_format("dt", "yyyy-MM") == month).select("dt").distinct().join(self._fresh(), F.col("dt") == F.col("__fresh"), "left_anti")
            for r in taken.collect():  # at most 31
                self._drop_day(str(r["dt"]))
        return n

    def read(self) -> DataFrame:
        """All rows once: fresh days from the daily tier, others from the monthly one."""
        parts, fresh = [], self._fresh()
        if has_partitions(self.spark, self.daily, "dt"):
            parts.append(self._days().join(fresh, F.col("dt") == F.col("__fresh"), "left_semi"))
        if has_partitions(self.spark, self.monthly, "month"):
            parts.append(self.spark.read.parquet(self.monthly).drop("month").join(fresh, F.col("dt") == F.col("__fresh"), "left_anti"))
        if not parts:
            raise FileNotFoundError(f"{self.name} has no rows yet")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def query(self, sql: str) -> DataFrame:
        self.read().createOrReplaceTempView(self.name)
        return self.spark.sql(sql)

    def status(self) -> DataFrame:
        """table, days, first_day, last_day, rows of successful ingests, compactions, first_month, last_month."""
        ok = self.log().where("status = 'success'")
        day, month = F.col("kind") == "ingest", F.col("kind") == "compact"
        return ok.groupBy("table").agg(
            F.count_if(day).alias("days"), F.min(F.when(day, F.col("period"))).alias("first_day"), F.max(F.when(day, F.col("period"))).alias("last_day"),
            F.sum(F.when(day, F.col("rows"))).alias("rows"), F.count_if(month).alias("compactions"),
            F.min(F.when(month, F.col("period"))).alias("first_month"), F.max(F.when(month, F.col("period"))).alias("last_month"),
        )


def expected_files(tier: str, period: str, explicit: int | None = None) -> int | None:
    """How many files a rollup of that period needs: as given, the month's days, or 12 months."""
    if explicit is not None:
        return explicit
    if tier == "monthly":
        y, m = map(int, period.split("-")[:2])
        return (dt.date(y + m // 12, m % 12 + 1, 1) - dt.date(y, m, 1)).days
    return 12 if tier == "yearly" else None


def rollup(spark: SparkSession, sources: str | list[str], target: str, fmt: str = "parquet", out_fmt: str = "parquet", pattern: str | None = None, expected: int | None = None, clean: bool = True, skip_existing: bool = True, gzip: bool = False, summarise: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, Any]:
    """Many files to one cleaned output. Counts of files that differ from what is expected, no files and unreadable ones are errors."""
    if skip_existing and path_exists(spark, f"{target}/_SUCCESS"):
        return {"status": "skipped", "target": target}
    try:
        df = read_files(spark, sources, fmt, recursive=True, pattern=pattern)
        # an output folder of Spark's, with its part files, counts as one file
        files = df.select(F.count_distinct(F.regexp_replace("_metadata.file_path", "/part-[^/]*$", ""))).first()[0] if fmt == "parquet" else len(df.inputFiles())
    except Exception as e:
        raise RollupError(f"{sources} can't be read: {e}") from e
    if not files:
        raise RollupError(f"no files match {sources}")
    if expected is not None and files != expected:
        raise RollupError(f"expected {expected}, got {files}")
    df = auto_numeric(null_markers(df)) if clean else df
    df = summarise(df) if summarise else df
    write_output(df, target, out_fmt, gzip=gzip)
    return {"status": "written", "target": target, "files": files}


def rollup_tiers(spark: SparkSession, base: str, template: str, years: list[int], months: Mapping[int, list[int]] | None = None, strict: bool = False) -> list[dict[str, Any]]:
    """daily to monthly to yearly, folders by template, e.g. "{tier}/data_{period}" with the period as 2024_01 or 2024."""
    out = []
    for y in years:
        for m in (months or {}).get(y, range(1, 13)):
            days = f"{base}/" + template.format(tier="daily", period=f"{y}_{m:02d}_*")
            monthly = f"{base}/" + template.format(tier="monthly", period=f"{y}_{m:02d}")
            out.append(rollup(spark, days, monthly, expected=expected_files("monthly", f"{y}-{m:02d}") if strict else None, clean=False))
        whole = f"{base}/" + template.format(tier="monthly", period=f"{y}_*")
        out.append(rollup(spark, whole, f"{base}/" + template.format(tier="yearly", period=str(y)), expected=12 if strict else None, clean=False))
    return out
