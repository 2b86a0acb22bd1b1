"""Ordered, named SQL models over sources, with templates, checks and outputs."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.checks import run_checks
from tidemill.sources.readers import register
from tidemill.sources.writers import write_output, write_partitioned


def rendered(value: Any, params: Mapping[str, Any]) -> Any:
    """Replaces {{ name }} in all texts of a nested value; unknown names stay."""
    if isinstance(value, str):
        return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(params[m[1]]) if m[1] in params else m[0], value)
    if isinstance(value, Mapping):
        return {k: rendered(v, params) for k, v in value.items()}
    return [rendered(v, params) for v in value] if isinstance(value, (list, tuple)) else value


def date_params(params: Mapping[str, Any], now: dt.datetime | None = None) -> dict[str, Any]:
    """today, yesterday, year, month, day, hour, and date_underscore and date_compact of a `date` parameter."""
    now = now or dt.datetime.now(dt.timezone.utc)
    out = {"today": f"{now:%Y-%m-%d}", "yesterday": f"{now - dt.timedelta(days=1):%Y-%m-%d}", "year": f"{now:%Y}", "month": f"{now:%m}", "day": f"{now:%d}", "hour": f"{now:%H}"} | dict(params)
    if "date" in params:
        out |= {"date_underscore": str(params["date"]).replace("-", "_"), "date_compact": str(params["date"]).replace("-", "")}
    return out


def model_sql(model: Mapping[str, Any]) -> str:
    """A model's SQL, given in place or as a file, exactly one of both."""
    if bool(model.get("sql")) == bool(model.get("sql_file")):
        raise ValueError(f"model {model.get('name')!r} needs sql or sql_file, and not both")
    if model.get("sql"):
        return model["sql"]
    with open(model["sql_file"], encoding="utf-8") as f:
        return f.read()


class ModelRun(dict):
    """The models' DataFrames by name. As a context it lets go of materialised ones at the end."""

    def counts(self) -> DataFrame:
        """model and rows of every model, in one job."""
        each = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("model"), "rows") for name, df in self.items()]
        return reduce(DataFrame.union, each)

    def release(self) -> None:
        for df in self.values():
            df.unpersist()

    def __enter__(self) -> ModelRun:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def run_models(spark: SparkSession, config: Mapping[str, Any], params: Mapping[str, Any] | None = None, base: str = "") -> ModelRun:
    """sources, models {name, sql, materialized: view | table, output}, validations. Checks run before outputs are written (validate: after turns that round)."""
    config = rendered(config, date_params(params or {}))
    register(spark, config.get("sources", {}), base)
    out = ModelRun()
    for m in config["models"]:
        df = spark.sql(model_sql(m))
        if m.get("materialized", "view") == "table":
            df = df.persist()
        df.createOrReplaceTempView(m["name"])
        out[m["name"]] = df
    checks = config.get("validations", [])
    if checks and config.get("validate") != "after":
        run_checks(spark, checks)
    for m in config["models"]:
        if o := m.get("output"):
            if o.get("partition_by") or o.get("partition_by_expression"):
                write_partitioned(out[m["name"]], o["path"], o.get("partition_by"), o.get("partition_by_expression"), o.get("partition_column_name"), o.get("mode", "replace_partition"), o.get("sort_by"))
            else:
                write_output(out[m["name"]], o["path"], o.get("format", "parquet"), o.get("sort_by"))
    if checks and config.get("validate") == "after":
        run_checks(spark, checks)
    return out
