"""Queries of SQL models, checks, splits, imputation, metrics, training and batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import checks as K
from tidemill.operators import experiments as EX
from tidemill.operators import linear
from tidemill.operators import metrics as M
from tidemill.operators import ml
from tidemill.operators.features import aggregate
from tidemill.operators.sqlmodels import run_models
from tidemill.plans.registry import query, table
from tidemill.plans.tabular import LINE_KEY
from tidemill.sources import writers as W
from tidemill.sources.readers import read_files
from tidemill.sources.scratch import scratch_path, stored

# SQL models -------------------------------------------------------------------


@query("sql_models", "SELECT o_custkey, n, total FROM (SELECT o_custkey, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1) WHERE n >= 5")
def sql_models(spark: SparkSession, sf: str) -> DataFrame:
    return run_models(spark, {
        "sources": {"sm_orders": {"path": f"{sf}/orders.parquet"}},
        "models": [{"name": "sm_by_customer", "sql": "SELECT o_custkey, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM sm_orders GROUP BY 1"}, {"name": "sm_busy", "sql": "SELECT * FROM sm_by_customer WHERE n >= 5"}],
        "validations": [{"name": "positive", "type": "failing_rows", "sql": "SELECT * FROM sm_by_customer WHERE n < 1"}],
    })["sm_busy"]


@query("sql_model_counts", "SELECT 'mc_by_customer' AS model, COUNT(DISTINCT o_custkey) AS \"rows\" FROM orders UNION ALL SELECT 'mc_all', COUNT(*) FROM orders")
def sql_model_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The row count of each model."""
    models = [{"name": "mc_by_customer", "sql": "SELECT o_custkey, COUNT(*) AS n FROM mc_orders GROUP BY 1", "materialized": "table"}, {"name": "mc_all", "sql": "SELECT * FROM mc_orders"}]
    with run_models(spark, {"sources": {"mc_orders": {"path": f"{sf}/orders.parquet"}}, "models": models}) as run:
        return stored(run.counts(), "model-counts")


@query("sql_models_templated", "SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderstatus = 'F' GROUP BY 1")
def sql_models_templated(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "templated")
    run_models(spark, {
        "sources": {"st_orders": {"path": "{{ folder }}/orders.parquet"}},
        "models": [{"name": "st_days", "sql": "SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM st_orders WHERE o_orderdate >= DATE '{{ date }}' AND o_orderstatus = '{{ state }}' GROUP BY 1", "output": {"path": out + "/{{ date_compact }}", "sort_by": ["day"]}}],
    }, {"folder": sf, "date": "1996-01-01", "state": "F"})
    return read_files(spark, f"{out}/19960101")


@query("pipeline_features", "SELECT c_custkey, COALESCE(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def pipeline_features(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "features")
    run_models(spark, {
        "sources": {"pf_c": {"path": f"{sf}/customer.parquet"}, "pf_o": {"path": f"{sf}/orders.parquet"}, "pf_n": {"sql": "SELECT o_custkey, COUNT(*) AS n FROM pf_o GROUP BY 1"}},
        "models": [{"name": "pf_features", "sql": "SELECT c_custkey, COALESCE(n, 0) AS n FROM pf_c LEFT JOIN pf_n ON c_custkey = o_custkey", "output": {"path": f"{out}/pf_features"}}],
    })
    return read_files(spark, f"{out}/pf_features")


# Checks --------------------------------------------------------------------------


@query("validate_failing_rows", "SELECT 'no_free_orders' AS name, 'error' AS severity, COUNT(*) = 0 AS passed, CAST(COUNT(*) AS DOUBLE) AS \"value\" FROM orders WHERE o_totalprice <= 0")
def validate_failing_rows(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("vf_orders")
    return K.run_checks(spark, [{"name": "no_free_orders", "type": "failing_rows", "sql": "SELECT * FROM vf_orders WHERE o_totalprice <= 0"}])


@query("validate_metric", "SELECT 'mean_price' AS name, 'warn' AS severity, AVG(o_totalprice) < 10 AS passed, round(AVG(o_totalprice), 4) AS \"value\" FROM orders")
def validate_metric(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("vm_orders")
    out = K.run_checks(spark, [{"name": "mean_price", "type": "metric", "sql": "SELECT AVG(o_totalprice) FROM vm_orders", "operator": "lt", "threshold": 10, "severity": "warn"}])
    return out.withColumn("value", F.round("value", 4))


@query("validation_report", "SELECT 'rows' AS name, 'error' AS severity, TRUE AS passed, CAST(COUNT(*) AS DOUBLE) AS \"value\" FROM customer UNION ALL SELECT 'debtors', 'warn', COUNT(*) = 0, CAST(COUNT(*) AS DOUBLE) FROM customer WHERE c_acctbal < 0")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "customer").createOrReplaceTempView("vr_customer")
    return K.run_checks(spark, [
        {"name": "rows", "type": "metric", "sql": "SELECT COUNT(*) FROM vr_customer", "operator": "gte", "threshold": 1},
        {"name": "debtors", "type": "failing_rows", "sql": "SELECT * FROM vr_customer WHERE c_acctbal < 0", "severity": "warn"},
    ])


@query("validate_group_count", "SELECT o_custkey, COUNT(*) AS \"rows\" FROM orders GROUP BY 1 HAVING COUNT(*) < 8 OR COUNT(*) > 15")
def validate_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return K.group_count(table(spark, sf, "orders"), ["o_custkey"], 8, 15)


@query("validate_group_sum", "SELECT o_custkey, CAST(SUM(o_orderkey % 10) AS BIGINT) AS total FROM orders GROUP BY 1 HAVING abs(SUM(o_orderkey % 10) - 45) > 12")
def validate_group_sum(spark: SparkSession, sf: str) -> DataFrame:
    return K.group_sum(table(spark, sf, "orders").withColumn("x", F.col("o_orderkey") % 10), ["o_custkey"], "x", 45, 12)


@query("validate_column_range", "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 45")
def validate_column_range(spark: SparkSession, sf: str) -> DataFrame:
    return K.column_range(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 5, 45)


@query("validate_not_null", "SELECT COUNT(*) FILTER (WHERE NULLIF(o_orderpriority, '1-URGENT') IS NULL) AS p, COUNT(*) FILTER (WHERE o_custkey IS NULL) AS o_custkey FROM orders")
def validate_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return K.null_counts(table(spark, sf, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))), ["p", "o_custkey"])


# Imputation and splits ----------------------------------------------------------------


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"))


_STATS = "(SELECT median(o_totalprice) FROM orders WHERE o_orderkey % 4 > 0)", "(SELECT o_orderpriority FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)"


@query("impute_stats", f"SELECT {_STATS[0]} AS price, {_STATS[1]} AS priority")
def impute_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = M.impute_stats(_gaps(spark, sf), ["price", "priority"])
    return spark.createDataFrame([(s["price"], s["priority"])], "price double, priority string")


@query("impute_apply", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice ELSE {_STATS[0]} END AS price, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE {_STATS[1]} END AS priority FROM orders")
def impute_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = _gaps(spark, sf)
    return M.impute(rows, M.impute_stats(rows, ["price", "priority"]))


def _share(*keys: str) -> str:
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5({text} || '|42'), 1, 8) AS BIGINT) % 10000"


@query("split_random", f"SELECT o_orderkey, {_share('o_orderkey')} < 2000 AS is_test FROM orders")
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_random(table(spark, sf, "orders"), ["o_orderkey"], 0.2).select("o_orderkey", "is_test")


@query("split_group_random", f"SELECT o_orderkey, {_share('o_custkey')} < 2500 AS is_test FROM orders")
def split_group_random(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_random(table(spark, sf, "orders"), ["o_custkey"], 0.25).select("o_orderkey", "is_test")


@query("split_time_cutoff", "SELECT event_id, ts >= TIMESTAMP '2024-01-20' AS is_test FROM events")
def split_time_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_time(table(spark, sf, "events"), "ts", cutoff="2024-01-20").select("event_id", "is_test")


@query("split_time_fraction", "SELECT event_id, ROW_NUMBER() OVER (ORDER BY ts, event_id) > CAST(floor((SELECT COUNT(*) FROM events) * 0.8) AS BIGINT) AS is_test FROM events")
def split_time_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_time(table(spark, sf, "events"), "ts", test_size=0.2, tiebreak=["event_id"]).select("event_id", "is_test")


@query("split_group_time", """
WITH g AS (SELECT user_id, MIN(ts) AS t FROM events GROUP BY 1), r AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY t, user_id) > CAST(floor((SELECT COUNT(*) FROM g) * 0.7) AS BIGINT) AS is_test FROM g)
SELECT event_id, is_test FROM events JOIN r USING (user_id)
""")
def split_group_time(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_group_time(table(spark, sf, "events"), "user_id", "ts", 0.3).select("event_id", "is_test")


# Metrics --------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a label, a predicted class and a score made of their columns."""
    li = table(spark, sf, "lineitem")
    return li.select(
        *LINE_KEY, (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") > 30).cast("int").alias("predicted"), (F.col("l_discount") * 9 + 0.01).alias("p"),
        "l_returnflag", F.when(F.col("l_quantity") > 30, "R").when(F.col("l_discount") > 0.05, "N").otherwise("A").alias("flag"), "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))


_SCORED = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(l_returnflag = 'R' AS INT) AS label, CAST(l_quantity > 30 AS INT) AS predicted, l_discount * 9 + 0.01 AS p, l_returnflag, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_discount > 0.05 THEN 'N' ELSE 'A' END AS flag, l_extendedprice, l_quantity * 1500 AS guess FROM lineitem)"


@query("confusion_matrix", f"SELECT l_returnflag AS actual, flag AS predicted, COUNT(*) AS n FROM {_SCORED} GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(_scored(spark, sf), "l_returnflag", "flag")


@query("metrics_classification", f"""
WITH c AS (SELECT COUNT(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp, COUNT(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp, COUNT(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn, COUNT(*) AS n, COUNT(*) FILTER (WHERE label = predicted) AS ok FROM {_SCORED}),
k AS (SELECT v, COUNT(*) FILTER (WHERE l_returnflag = v) AS s, COUNT(*) FILTER (WHERE flag = v) AS f, COUNT(*) FILTER (WHERE l_returnflag = v AND flag = v) AS h FROM {_SCORED}, (SELECT unnest(['A', 'N', 'R']) AS v) GROUP BY v)
SELECT 'binary' AS kind, round(ok / n, 8) AS accuracy, round(tp / (tp + fp), 8) AS "precision", round(tp / (tp + fn), 8) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c
UNION ALL SELECT 'weighted', round(SUM(h) / SUM(s), 8), round(SUM(s * h / f) / SUM(s), 8), round(SUM(h) / SUM(s), 8), round(SUM(s * 2.0 * h / (s + f)) / SUM(s), 8) FROM k
""")
def metrics_classification(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf)
    a = M.classification(rows, "label", "predicted").withColumn("kind", F.lit("binary"))
    b = M.classification(rows, "l_returnflag", "flag", "R").withColumn("kind", F.lit("weighted"))
    return a.unionByName(b).select("kind", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("metrics_regression", f"SELECT round(AVG(pow(l_extendedprice - guess, 2)), 2) AS mse, round(sqrt(AVG(pow(l_extendedprice - guess, 2))), 4) AS rmse, round(AVG(abs(l_extendedprice - guess)), 4) AS mae, round(1 - AVG(pow(l_extendedprice - guess, 2)) / var_pop(l_extendedprice), 6) AS r2 FROM {_SCORED}")
def metrics_regression(spark: SparkSession, sf: str) -> DataFrame:
    return M.regression(_scored(spark, sf), "l_extendedprice", "guess").select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


_CLIP = "least(greatest(p, 1e-15), 1 - 1e-15)"


@query("metrics_binary", f"SELECT round(AVG(CASE WHEN label = 1 THEN -ln({_CLIP}) ELSE -ln(1 - {_CLIP}) END), 6) AS log_loss, round(AVG(pow(p - label, 2)), 6) AS brier FROM {_SCORED}")
def metrics_binary(spark: SparkSession, sf: str) -> DataFrame:
    return M.binary(_scored(spark, sf), "label", "p").select(F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query("metrics_auc", f"""
WITH r AS (SELECT label, (RANK() OVER (ORDER BY p) + (SELECT 0) + (RANK() OVER (ORDER BY p) + COUNT(*) OVER (PARTITION BY p) - 1)) / 2.0 AS mid FROM {_SCORED})
SELECT round((SUM(mid) FILTER (WHERE label = 1) - SUM(label) * (SUM(label) + 1) / 2.0) / (SUM(label) * (COUNT(*) - SUM(label))), 8) AS auc FROM r
""")
def metrics_auc(spark: SparkSession, sf: str) -> DataFrame:
    return M.auc(_scored(spark, sf), "label", "p").select(F.round("auc", 8).alias("auc"))


@query("group_softmax", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, round(exp(l_tax * 10) / SUM(exp(l_tax * 10)) OVER (PARTITION BY l_orderkey), 8) AS p FROM lineitem")
def group_softmax(spark: SparkSession, sf: str) -> DataFrame:
    out = M.group_softmax(table(spark, sf, "lineitem").withColumn("s", F.col("l_tax") * 10), "l_orderkey", "s")
    return out.select(*LINE_KEY[:-1], F.col("l_shipdate").cast("date").alias("l_shipdate"), F.round("p", 8).alias("p"))


_TIE = "l_linenumber, l_partkey, l_suppkey, l_shipdate"
_TOP = f"SELECT * FROM {_SCORED} QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY p DESC, {_TIE}) = 1"


@query("top1_accuracy", f"SELECT COUNT(*) AS groups, round(AVG(label), 8) AS top1_accuracy FROM ({_TOP})")
def top1_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return M.top1(_scored(spark, sf), "l_orderkey", "p", LINE_KEY[1:]).agg(F.count_distinct("l_orderkey").alias("groups"), F.round(F.avg("label"), 8).alias("top1_accuracy"))


@query("group_metrics", f"""
WITH s AS (SELECT * FROM {_SCORED} QUALIFY SUM(label) OVER (PARTITION BY l_orderkey) = 1), t AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY p DESC, {_TIE}) = 1)
SELECT (SELECT COUNT(*) FROM t) AS groups, (SELECT round(AVG(label), 8) FROM t) AS top1_accuracy, (SELECT round(AVG(-ln({_CLIP})), 6) FROM s WHERE label = 1) AS log_loss
""")
def group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = M.group_metrics(_scored(spark, sf), "l_orderkey", "label", "p", LINE_KEY[1:])
    return out.select("groups", F.round("top1_accuracy", 8).alias("top1_accuracy"), F.round("log_loss", 6).alias("log_loss"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs made of suppliers, their parameters and metrics of lines."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(aggregate("avg", "l_discount").alias("test_score"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("tags"))


@query("best_run", "SELECT l_suppkey AS name, round(AVG(l_discount), 8) AS test_score, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY 1 ORDER BY AVG(l_discount) DESC, 1 LIMIT 1")
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    return M.best(_runs(spark, sf), "test_score").withColumn("test_score", F.round("test_score", 8))


def _solved(features: list[str]) -> list[str]:
    """SQL of the weights w0, w1 ... that solve the ridge's equations, by Cramer's rule, from the columns a{i}{j} (alpha on the diagonal) and b{i}."""

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'+' if k % 2 == 0 else '-'} {m[0][k]} * {det([[*r[:k], *r[k + 1 :]] for r in m[1:]])}" for k in range(len(m))) + ")"

    n = len(features)
    a = [[f"a{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]
    return [f"{det([[f'b{i}' if j == k else a[i][j] for j in range(n)] for i in range(n)])} / {det(a)} AS w{k}" for k in range(n)]


def _line_sql(features: list[str], target: str, alpha: str, source: str, by: str = "") -> str:
    """SQL of w0 ... and c (the intercept) of a ridge over a source."""
    n = len(features)
    gram = [f"count(*) * covar_pop({features[i]}, {features[j]}){f' + {alpha}' if i == j else ''} AS a{i}{j}" for i in range(n) for j in range(i, n)]
    rest = [f"count(*) * covar_pop({f}, {target}) AS b{i}, avg({f}) AS x{i}" for i, f in enumerate(features)]
    group = f" GROUP BY {by}" if by else ""
    first = f"SELECT {by + ', ' if by else ''}{', '.join(gram + rest)}, avg({target}) AS y FROM {source}{group}"
    return f"SELECT *, y - {' - '.join(f'w{i} * x{i}' for i in range(n))} AS c FROM (SELECT *, {', '.join(_solved(features))} FROM ({first}))"


_LINES = f"lines AS (SELECT *, CAST(l_extendedprice AS DOUBLE) AS price, {_share(*LINE_KEY[:-1])} < 2000 AS is_test FROM lineitem)"
_ONE_FEATURE = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}


def _compare_sql() -> str:
    runs = " UNION ALL ".join(f"SELECT '{n}' AS name, w0, c FROM ({_line_sql([f], 'price', '5.0', '(SELECT * FROM lines WHERE NOT is_test)')})" for n, f in _ONE_FEATURE.items())
    tested = " UNION ALL ".join(f"SELECT name, price AS y, w0 * {f} + c AS p, price > 30000 AS dear FROM lines, runs WHERE is_test AND name = '{n}'" for n, f in _ONE_FEATURE.items())
    return f"""
WITH {_LINES}, runs AS ({runs}), tested AS ({tested}),
scores AS (SELECT name, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS test_score, sqrt(avg((y - p) * (y - p))) AS rmse FROM tested GROUP BY 1),
ranked AS (SELECT name, dear, rank() OVER (PARTITION BY name ORDER BY p) + (count(*) OVER (PARTITION BY name, p) - 1) / 2.0 AS r FROM tested),
aucs AS (SELECT name, (sum(r) FILTER (WHERE dear) - count(*) FILTER (WHERE dear) * (count(*) FILTER (WHERE dear) + 1) / 2.0) / (count(*) FILTER (WHERE dear) * 1.0 * count(*) FILTER (WHERE NOT dear)) AS auc FROM ranked GROUP BY 1)
(SELECT 'test_score' AS metric, name, round(test_score, 6) AS value FROM scores ORDER BY test_score DESC, name LIMIT 1)
UNION ALL (SELECT 'rmse', name, round(rmse, 4) FROM scores ORDER BY rmse, name LIMIT 1) UNION ALL (SELECT 'auc', name, round(auc, 6) FROM aucs ORDER BY auc DESC, name LIMIT 1)
"""


@query("compare_models", _compare_sql())
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    """The best of an experiment's runs by R squared, by RMSE and by the area under the curve of dear lines."""
    rows = _training(spark, sf).withColumn("dear", (F.col("l_extendedprice") > 30000).cast("double"))
    config = {"model": "ridge", "target": "l_extendedprice", "binary_target": "dear", "leakage_columns": ["dear"], "params": {"alpha": 5.0}}
    path = scratch_path(spark, "comparison")
    EX.run_experiment(rows.where("not is_test"), rows.where("is_test"), {n: {**config, "features": [f]} for n, f in _ONE_FEATURE.items()}, path, "one feature")
    out = EX.compared(spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/metrics"), {"test_score": True, "rmse": False, "auc": True})
    return out.withColumn("value", F.when(F.col("metric") == "rmse", F.round("value", 4)).otherwise(F.round("value", 6)))


# Post-processing ----------------------------------------------------------------------------


@query("post_processing", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS prediction, CAST(o_custkey * 2 AS DOUBLE) AS twice, o_custkey > 100 AS big FROM orders")
def post_processing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("prediction"))
    return ml.post_process(rows, [{"name": "twice", "expression": "prediction * 2"}, {"name": "big", "expression": "prediction > 100"}])


@query("probability_expression", "SELECT o_orderkey, round(1 / (1 + exp(-o_custkey / 1000.0)), 8) AS p FROM orders")
def probability_expression(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("score"))
    return rows.select("o_orderkey", F.round(ml.probability_column("1 / (1 + exp(-{prediction} / 1000.0))", "score"), 8).alias("p"))


# Training and scoring ---------------------------------------------------------------------------

_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_CONFIGS = {
    "ridge": {"model": "ridge", "target": "l_extendedprice", "features": _FEATURES, "params": {"alpha": 0.1}},
    "logistic": {"model": "logistic_regression", "target": "label", "features": [*_FEATURES, "days"], "leakage_columns": ["l_returnflag"], "params": {"max_iter": 20}},
    "forest": {"model": "random_forest_classifier", "target": "label", "features": [*_FEATURES, "days"], "leakage_columns": ["l_returnflag"], "params": {"n_estimators": 8}},
    "boosting": {"model": "gradient_boosting_regressor", "target": "l_extendedprice", "features": _FEATURES, "params": {"n_estimators": 5}},
}


def _training(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    rows = li.withColumns({"label": (F.col("l_returnflag") == "R").cast("double"), "days": F.datediff("l_shipdate", F.lit("1995-01-01"))})
    return M.split_random(rows, LINE_KEY[:-1], 0.2)


def _trained(name: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        config, rows = _CONFIGS[name], _training(spark, sf)
        model = ml.train(rows.where("not is_test"), config)
        return ml.predictions(model, rows.where("is_test"), config, [*LINE_KEY[:-1], *config["features"], *config.get("leakage_columns", [])])

    return run


for _name in _CONFIGS:
    if _name != "ridge":
        query(f"train_{_name}")(_trained(_name))


@query("train_ridge", f"""
WITH {_LINES}, line AS ({_line_sql(_FEATURES, "price", "0.1", "(SELECT * FROM lines WHERE NOT is_test)")})
SELECT {", ".join(LINE_KEY[:-1])}, {", ".join(_FEATURES)}, price AS l_extendedprice_actual, round({" + ".join(f"w{i} * {f}" for i, f in enumerate(_FEATURES))} + c, 2) AS l_extendedprice_pred FROM lines, line WHERE is_test
""")
def train_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the rows held out, against the ridge's closed form."""
    return _trained("ridge")(spark, sf).withColumn("l_extendedprice_pred", F.round("l_extendedprice_pred", 2))


_FOLDS = ["l_quantity", "l_discount"]


def _folds_sql() -> str:
    rows = "SELECT CAST(l_extendedprice AS DOUBLE) AS price, l_quantity, l_discount, (l_orderkey * 7 + l_linenumber) % 3 AS fold FROM lineitem"
    left = f"(SELECT r.*, f.f, a.alpha FROM ({rows}) r, (SELECT unnest([0, 1, 2])::BIGINT AS f) f, (SELECT unnest([0.1, 100000.0]::DOUBLE[]) AS alpha) a WHERE r.fold <> f.f)"
    return f"""
SELECT alpha, f AS fold, count(*) AS n, round(sqrt(avg((price - p) * (price - p))), 4) AS rmse, round(1 - sum((price - p) * (price - p)) / (var_pop(price) * count(*)), 6) AS r2, round(any_value(c), 4) AS intercept
FROM (SELECT r.price, l.alpha, l.f, l.c, w0 * r.l_quantity + w1 * r.l_discount + c AS p FROM ({rows}) r JOIN ({_line_sql(_FOLDS, "price", "any_value(alpha)", left, "alpha, f")}) l ON r.fold = l.f) GROUP BY 1, 2
"""


@query("cross_validate", _folds_sql())
def cross_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Three folds and two penalties from one pass."""
    rows = table(spark, sf, "lineitem").withColumn("fold", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 3).cast("bigint"))
    out = linear.cross_validate(rows, _FOLDS, "l_extendedprice", "fold", [0.1, 100000.0])
    return out.select("alpha", "fold", "n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("intercept", 4).alias("intercept"))


_CHOICE = """
WITH RECURSIVE marked AS (
  SELECT l_orderkey AS g, l_quantity / 50.0 AS x, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) = 1 THEN 1 ELSE 0 END AS y FROM lineitem
), newton(k, w) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, any_value(w) + sum(gx) / sum(hx) FROM (
    SELECT k, any_value(w) AS w, sum(CASE WHEN y = 1 THEN x END) - sum(x * exp(w * x)) / sum(exp(w * x)) AS gx, sum(x * x * exp(w * x)) / sum(exp(w * x)) - (sum(x * exp(w * x)) / sum(exp(w * x))) ** 2 AS hx
    FROM newton, marked WHERE k < 12 GROUP BY k, g
  ) GROUP BY k
)
SELECT count(*) AS groups, round(any_value(w), 6) AS weight, round(avg(loss), 6) AS log_loss FROM (
  SELECT any_value(w) AS w, ln(sum(exp(w * x))) - sum(CASE WHEN y = 1 THEN w * x END) AS loss FROM (SELECT w FROM newton WHERE k = 12), marked GROUP BY g
)
"""


@query("group_training", _CHOICE)
def group_training(spark: SparkSession, sf: str) -> DataFrame:
    """Which line of an order is its dearest, by quantity: a model trained inside orders."""
    rows = table(spark, sf, "lineitem").select(*LINE_KEY, "l_extendedprice", (F.col("l_quantity") / 50.0).alias("x"))
    top = rows.groupBy(F.col("l_orderkey").alias("g")).agg(F.min_by(F.struct(*LINE_KEY[1:]), F.struct(-F.col("l_extendedprice"), *LINE_KEY[1:])).alias("top"))
    won = (F.struct(*LINE_KEY[1:]) == F.col("top")).cast("tinyint").alias("won")
    # Written once, three columns, as the fit and its shares read them again and again.
    rows = stored(rows.join(top, F.col("l_orderkey") == F.col("g")).select("l_orderkey", "x", won), "marked-lines")
    m = linear.group_choice(rows, "l_orderkey", "won", ["x"])
    shares = m.scored(rows, "l_orderkey", ["l_orderkey", "won"])
    groups, loss = linear.group_losses(shares, "l_orderkey", "won")
    return shares.sparkSession.createDataFrame([(groups, m.weights[0], loss)], "groups bigint, weight double, log_loss double").select("groups", F.round("weight", 6).alias("weight"), F.round("log_loss", 6).alias("log_loss"))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows, config = _training(spark, sf), _CONFIGS["forest"]
    return ml.importance(ml.train(rows.where("not is_test"), config), config, rows)


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    rows, config = _training(spark, sf), _CONFIGS["logistic"]
    model = ml.train(rows.where("not is_test"), config)
    out = ml.score(model, rows.where("l_quantity > 10"), config, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["other", "returned"], {"min_quantity": 10})
    return stored(out.drop("inference_run_at"), "predictions")


@query("predict_batch")
def predict_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf)


@query("predict_to_file")
def predict_to_file(spark: SparkSession, sf: str) -> DataFrame:
    path, out = scratch_path(spark, "predictions-10"), _predicted(spark, sf)
    W.write_output(out.where("prediction = 1"), path, "csv")
    W.write_output(out.where("prediction = 0"), path, "csv", mode="append")
    return read_files(spark, path, "csv")


@query("predict_to_table")
def predict_to_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prediction-table")
    W.write_partitioned(W.with_ingest_date(_predicted(spark, sf), "parameter", "run_date", {"run_date": "2024-02-01"}), path, by="dt")
    return read_files(spark, path)


@query("feature_snapshot", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, true AS scored FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.05")
def feature_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """One filtered table is scored and kept, so the snapshot has exactly the rows of the predictions."""
    path, keys = scratch_path(spark, "snapshot"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows, config = _training(spark, sf), _CONFIGS["logistic"]
    picked = stored(rows.where("l_quantity > 10 and l_discount > 0.05"), "scored-features")
    W.write_output(picked.select(*LINE_KEY, "l_quantity", "l_discount"), path)
    out = ml.score(ml.train(rows.where("not is_test"), config), picked, config, LINE_KEY)
    back = read_files(spark, path)
    done = out.select(*[F.col(k).alias(f"p_{k}") for k in LINE_KEY]).distinct()
    met = back.join(done, [back[k] == done[f"p_{k}"] for k in LINE_KEY], "left")
    return met.select(*keys, "l_quantity", "l_discount", F.col("p_l_orderkey").isNotNull().alias("scored"))


@query("rows_with_a_target", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS price, 1 AS folds FROM lineitem WHERE l_returnflag <> 'N'")
def rows_with_a_target(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a target aren't trained on; cross-validation runs over the others."""
    rows = table(spark, sf, "lineitem").withColumn("price", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")))
    config = {"model": "ridge", "target": "price", "features": _FEATURES, "params": {"alpha": 0.1}}
    score = ml.cross_validated(rows, config, 2)
    return ml.with_target(rows, config).select("l_orderkey", "l_linenumber", "price", F.lit(1 if score > 0 else 0).alias("folds"))


# Experiments: what doesn't depend on the fit is checked in SQL ------------------------------------


def _experiment(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path, rows = scratch_path(spark, "experiment"), _training(spark, sf)
    configs = {
        "ridge": _CONFIGS["ridge"], "trees": {**_CONFIGS["boosting"], "params": {"n_estimators": 2}}, "leaky": {**_CONFIGS["ridge"], "leakage_columns": ["l_tax"]},
        "odd": {**_CONFIGS["ridge"], "model": "no such model"},
    }
    EX.run_experiment(rows.where("not is_test"), rows.where("is_test"), configs, path, "lines")
    return spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/metrics")


@query("experiment_runs", "SELECT name, status, n_metrics FROM (VALUES ('ridge', 'success', 3), ('trees', 'success', 3), ('leaky', 'failed', 0), ('odd', 'failed', 0)) t(name, status, n_metrics) WHERE (SELECT COUNT(*) FROM lineitem) > 0")
def experiment_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run with its status and number of metrics; two of four configurations fail, the others go on."""
    return EX.run_listing(*_experiment(spark, sf)).select("name", "status", F.coalesce(F.cardinality("metrics"), F.lit(0)).alias("n_metrics"))


@query("experiment_best", "SELECT 'test_score' AS metric, true AS is_best FROM lineitem LIMIT 1")
def experiment_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best run by R squared, held against the best of all metrics."""
    runs, metrics = _experiment(spark, sf)
    top = metrics.where("metric = 'test_score'").agg(F.max("value").alias("top"))
    return EX.best_run(runs, metrics, "test_score").join(top, F.col("value") == F.col("top"), "left").select(F.lit("test_score").alias("metric"), F.col("top").isNotNull().alias("is_best"))


@query("group_score_shares", "SELECT l_orderkey, COUNT(*) AS n, 1.0 :: DOUBLE AS total FROM lineitem GROUP BY 1")
def group_score_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a trained model compared inside each order: the shares of a group add up to 1."""
    rows, config = _training(spark, sf), _CONFIGS["ridge"]
    config = {**config, "target": "price", "features": ["l_discount", "l_tax", "l_quantity"]}
    scaled = rows.withColumn("price", F.col("l_extendedprice") / 10000)
    out = EX.group_scores(ml.train(scaled.where("not is_test"), config), scaled, config, "l_orderkey", LINE_KEY[1:])
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("share"), 6).alias("total"))


@query("test_output_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice AS l_extendedprice_actual, true AS predicted FROM lineitem")
def test_output_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The test output's keys, features and actual values for all rows; the prediction is there."""
    rows, config = _training(spark, sf), _CONFIGS["ridge"]
    out = ml.predictions(ml.train(rows.where("not is_test"), config), rows, config, ["l_orderkey", "l_linenumber", *config["features"]])
    return out.select("l_orderkey", "l_linenumber", *config["features"], "l_extendedprice_actual", F.col("l_extendedprice_pred").isNotNull().alias("predicted"))


_SCORED = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST('10' AS VARCHAR) AS param_min_quantity, true AS sums_to_one FROM lineitem WHERE l_quantity > 10"


@query("predict_batch_columns", _SCORED)
def predict_batch_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Row keys and parameters of batch scoring; the classes' probabilities add up to 1."""
    out = _predicted(spark, sf)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "param_min_quantity", (F.abs(F.col("prob_other") + F.col("prob_returned") - 1) < 1e-6).alias("sums_to_one"))


@query("predict_roundtrip", "SELECT l_orderkey, l_linenumber, DATE '2024-02-01' AS dt, true AS same FROM lineitem WHERE l_quantity > 10")
def predict_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions read back from a dated table, row by row as they were scored, with the features that were scored beside them."""
    path, out = scratch_path(spark, "prediction-table"), _predicted(spark, sf)
    W.write_partitioned(W.with_ingest_date(out, "parameter", "run_date", {"run_date": "2024-02-01"}), path, by="dt")
    row = lambda df: F.xxhash64(*[df[c] for c in sorted(out.columns)])
    back = read_files(spark, path)
    back = back.select("l_orderkey", "l_linenumber", "dt", row(back).alias("h"))
    sent = out.select(row(out).alias("sent")).distinct()
    return back.join(sent, F.col("h") == F.col("sent"), "left").select("l_orderkey", "l_linenumber", "dt", F.col("sent").isNotNull().alias("same"))
