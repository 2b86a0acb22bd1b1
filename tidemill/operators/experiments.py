"""Experiments: many models on one dataset, with a log of runs and metrics, and group scores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException, IllegalArgumentException, PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import ordering
from tidemill.operators import ml
from tidemill.operators.metrics import auc
from tidemill.sources.scratch import stored

RUNS = "experiment string, run_id string, name string, status string, error string, config string"
METRICS = "run_id string, metric string, value double"


def test_metrics(predicted: DataFrame, target: str, binary: str | None = None) -> dict[str, float]:
    """Accuracy and area under the curve where there are class probabilities, else RMSE, MAE and R squared, in one pass each; with a binary column also a regression's area under its curve."""
    y, p = F.col(f"{target}_actual"), F.col(f"{target}_pred")
    if f"{target}_pred_proba" in predicted.columns:
        accuracy = predicted.agg(F.avg((y == p).cast("double"))).first()[0]
        return {"test_score": accuracy, "auc": auc(predicted, f"{target}_actual", f"{target}_pred_proba").first()["auc"]}
    rmse, mae, r2 = predicted.agg(F.sqrt(F.avg((y - p) ** 2)), F.avg(F.abs(y - p)), 1 - F.sum((y - p) ** 2) / (F.var_pop(y) * F.count(y))).first()
    out = {"test_score": r2, "rmse": rmse, "mae": mae}
    return out | {"auc": auc(predicted, binary, f"{target}_pred").first()["auc"]} if binary else out


#: What a configuration can be wrong about; anything else, such as lost executors, ends the experiment.
FAULTS = (ValueError, KeyError, TypeError, PySparkValueError, PySparkTypeError, AnalysisException, IllegalArgumentException)


def run_experiment(train: DataFrame, test: DataFrame, configs: Mapping[str, Mapping[str, Any]], path: str, experiment: str) -> None:
    """Trains and tests every config in turn and appends its run and metrics to the logs at path; a config that is at fault is a failed run, and the others go on.

    Both sets are written once and read by every run.
    """
    spark = train.sparkSession
    train, test = stored(train, "experiment-train"), stored(test, "experiment-test")
    for name, config in configs.items():
        run_id, metrics, status, error = uuid.uuid4().hex, {}, "success", None
        try:
            binary = config.get("binary_target")
            predicted = ml.predictions(ml.train(train, config), test, config, [binary] if binary else [])
            metrics = test_metrics(predicted, config["target"], binary)
        except FAULTS as e:
            status, error = "failed", str(e).splitlines()[0][:500]
        spark.createDataFrame([(experiment, run_id, name, status, error, json.dumps(config))], RUNS).write.mode("append").parquet(f"{path}/runs")
        spark.createDataFrame([(run_id, k, float(v)) for k, v in metrics.items() if v is not None], METRICS).write.mode("append").parquet(f"{path}/metrics")


def run_listing(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every run, failed ones too, with its metrics as a map."""
    own = metrics.groupBy(F.col("run_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return runs.join(own, runs["run_id"] == own["id"], "left").drop("id")


def best_run(runs: DataFrame, metrics: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    """The run with the best value of a metric; the first by name on ties."""
    values = metrics.where(F.col("metric") == metric).select(F.col("run_id").alias("id"), "value")
    met = runs.join(values, runs["run_id"] == values["id"]).drop("id").where("value is not null and not isnan(value)")
    return met.orderBy(*ordering(["value DESC" if higher else "value", "name"])).limit(1)


def group_scores(model: Any, df: DataFrame, config: Mapping[str, Any], group: str, keep: list[str]) -> DataFrame:
    """keep, score (a regressor's prediction or a classifier's probability of class 1) and share: the scores' softmax inside each group."""
    out = ml.predictions(model, df, config, [group, *keep])
    t = config["target"]
    score = F.col(f"{t}_pred_proba") if f"{t}_pred_proba" in out.columns else F.col(f"{t}_pred")
    w = Window.partitionBy(group)
    out = out.select(group, *keep, score.alias("score")).withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return out.withColumn("share", F.col("e") / F.sum("e").over(w)).drop("e")


def compared(runs: DataFrame, metrics: DataFrame, by: Mapping[str, bool]) -> DataFrame:
    """metric, name and value of the best run by each metric {name: whether higher is better}, such as test_score and auc."""
    out = None
    for metric, higher in by.items():
        row = best_run(runs, metrics, metric, higher).select(F.lit(metric).alias("metric"), "name", "value")
        out = row if out is None else out.union(row)
    return out
