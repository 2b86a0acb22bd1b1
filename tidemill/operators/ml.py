"""Training, importances and batch scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.linear import ridge_penalty
from tidemill.sources.scratch import stored

#: Rows that a task of a fit holds, about; a fit's tasks grow in number with the rows, not in size.
FIT_ROWS = 500_000

MODELS = {
    "ridge": lambda p: R.LinearRegression(elasticNetParam=0.0, standardization=False, regParam=p.get("penalty", p.get("alpha", 1.0))),
    "logistic_regression": lambda p: C.LogisticRegression(maxIter=p.get("max_iter", 100), regParam=p.get("reg", 0.0)),
    "random_forest_classifier": lambda p: C.RandomForestClassifier(numTrees=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 5), seed=p.get("seed", 42)),
    "random_forest_regressor": lambda p: R.RandomForestRegressor(numTrees=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 5), seed=p.get("seed", 42)),
    "gradient_boosting_classifier": lambda p: C.GBTClassifier(maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 3), seed=p.get("seed", 42)),
    "gradient_boosting_regressor": lambda p: R.GBTRegressor(maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 3), seed=p.get("seed", 42)),
}

TREES = {k for k in MODELS if k.startswith(("random_forest", "gradient_boosting"))}


class LeakageError(ValueError):
    """Features that must not be used to predict the target."""


def check_features(df: DataFrame, config: Mapping[str, Any]) -> None:
    """Features exist, none is a leakage column, and a binary target is the target or a leakage column."""
    features, leaks = config["features"], set(config.get("leakage_columns", ()))
    if bad := sorted(leaks & set(features)):
        raise LeakageError(f"leakage columns among the features: {', '.join(bad)}")
    if missing := sorted(set(features) - set(df.columns)):
        raise ValueError(f"missing features: {', '.join(missing)}")
    binary = config.get("binary_target")
    if binary and binary != config.get("target") and binary not in leaks:
        raise LeakageError(f"{binary!r} must be the target or a leakage column")


def fit_partitions(rows: DataFrame, rows_a_task: int = FIT_ROWS) -> int:
    """Tasks for a fit over rows: the session's, or more where these would hold more rows than a task should."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_a_task))


def estimator(config: Mapping[str, Any]) -> Pipeline:
    """Imputation by train medians, assembly, the model; feature columns are cast to double beforehand."""
    kind = config["model"]
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}")
    x = [f"x_{f}" for f in config["features"]]
    model = MODELS[kind](config.get("params", {})).setFeaturesCol("features").setLabelCol("label")
    return Pipeline(stages=[Imputer(strategy="median", inputCols=x, outputCols=x), VectorAssembler(inputCols=x, outputCol="features"), model])


def prepared(df: DataFrame, config: Mapping[str, Any], fill: float | None = None) -> DataFrame:
    cast = {f"x_{f}": F.col(f).cast("double") if fill is None else F.coalesce(F.col(f).cast("double"), F.lit(fill)) for f in config["features"]}
    out = df.withColumns(cast)
    return out.withColumn("label", F.col(config["target"]).cast("double")) if config.get("target") in df.columns else out


def with_target(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """The rows that have a target."""
    return df.na.drop(subset=[config["target"]])


def train(df: DataFrame, config: Mapping[str, Any], rows_a_task: int = FIT_ROWS) -> PipelineModel:
    """Fits on rows with a target. For trees, which keep their rows in memory, features and targets are written once and dealt out so that no task of the fit holds many more than `rows_a_task`."""
    check_features(df, config)
    rows = with_target(df, config)
    if config["model"] == "ridge":  # alpha weighs against the sum of squared errors
        config = {**config, "params": {**config.get("params", {}), "penalty": ridge_penalty(rows, config)}}
    if config["model"] not in TREES:
        return estimator(config).fit(prepared(rows, config))
    x = [f"x_{f}" for f in config["features"]]
    rows = stored(prepared(rows, config).select(*x, "label"), "training-rows")
    *first, model = estimator(config).getStages()
    made = Pipeline(stages=first).fit(rows)
    dealt = made.transform(rows).select("features", "label").repartition(fit_partitions(rows, rows_a_task))
    return PipelineModel(stages=[*made.stages, model.fit(dealt)])


def cross_validated(df: DataFrame, config: Mapping[str, Any], folds: int = 3) -> float:
    """The mean metric over k folds."""
    check_features(df, config)
    regress = config["model"] in ("ridge", "random_forest_regressor", "gradient_boosting_regressor")
    judge = RegressionEvaluator(metricName="rmse") if regress else MulticlassClassificationEvaluator(metricName="accuracy")
    cv = CrossValidator(estimator=estimator(config), estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=42)
    return cv.fit(prepared(with_target(df, config), config)).avgMetrics[0]


def predictions(model: PipelineModel, df: DataFrame, config: Mapping[str, Any], keep: list[str]) -> DataFrame:
    """keep, <target>_actual, <target>_pred and, for classifiers, <target>_pred_proba (of class 1)."""
    t = config["target"]
    out = model.transform(prepared(df, config))
    proba = [vector_to_array("probability")[1].alias(f"{t}_pred_proba")] if "probability" in out.columns else []
    return out.select(*keep, F.col("label").alias(f"{t}_actual"), F.col("prediction").alias(f"{t}_pred"), *proba)


def importance(model: PipelineModel, config: Mapping[str, Any], df: DataFrame) -> DataFrame:
    """feature, importance: tree importances or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return df.sparkSession.createDataFrame([(f, abs(float(v))) for f, v in zip(config["features"], values.toArray(), strict=True)], "feature string, importance double")


def score(model: PipelineModel, df: DataFrame, config: Mapping[str, Any], identifiers: list[str], classes: list[str] | None = None, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Batch scoring in one plan: identifiers, prediction, prob_<class> and probabilities_json, model, inference_run_at, param_*."""
    check_features(df, {**config, "leakage_columns": ()})
    out = model.transform(prepared(df, config, fill=0.0))
    cols = [*map(F.col, identifiers), F.col("prediction").cast("double").alias("prediction")]
    if classes and "probability" in out.columns:
        p = vector_to_array("probability")
        safe = ["".join(ch if ch.isalnum() else "_" for ch in str(c)) for c in classes]
        cols += [p[i].alias(f"prob_{c}") for i, c in enumerate(safe)]
        cols.append(F.to_json(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(str(c)), p[i])])).alias("probabilities_json"))
    cols += [F.lit(config["model"]).alias("model"), F.current_timestamp().alias("inference_run_at")]
    cols += [F.lit(str(v)).alias(f"param_{k}") for k, v in (params or {}).items()]
    return out.select(*cols)


def post_process(df: DataFrame, columns: list[Mapping[str, str]]) -> DataFrame:
    """Adds columns {name, expression}; every expression sees only the columns that came in, prediction as double."""
    df = df.withColumn("prediction", F.col("prediction").cast("double"))
    return df.select("*", *[F.expr(c["expression"]).alias(c["name"]) for c in columns])


def probability_column(expression: str, prediction: str = "prediction"):  # noqa: ANN201
    """A probability from an expression with a {prediction} place."""
    return F.expr(expression.replace("{prediction}", prediction)).cast("double")


def area_under_roc(df: DataFrame) -> float:
    return BinaryClassificationEvaluator().evaluate(df)
