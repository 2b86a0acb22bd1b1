"""Queries of sources, expressions, filters, joins, aggregates, windows and look-back features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import exprs as X
from tidemill.operators import features as FE
from tidemill.operators.dataset import build_dataset, merge_sources
from tidemill.operators.history import History
from tidemill.operators.rank import global_rank
from tidemill.plans.registry import query, table
from tidemill.sources import readers as R
from tidemill.sources.readers import read_files, register
from tidemill.sources.scratch import scratch_path

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
_LK = ", ".join(LINE_KEY)
EVENTS = History("user_id", "ts", ["event_id"])




# Sources ---------------------------------------------------------------------


@query("scan_parquet", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    df = read_files(spark, f"{sf}/lineitem.parquet").where("l_quantity > 25")
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("scan_csv", "SELECT CAST(o_orderkey AS INT) AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", True).csv(path)
    return read_files(spark, path, "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("int"))


@query("scan_json", "SELECT event_id, event_type, value FROM events")
def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return read_files(spark, path, "jsonl").select("event_id", "event_type", "value")


@query("scan_jsonl_gz", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_jsonl_gz(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("compression", "gzip").json(path)
    return read_files(spark, path, "jsonl").select("c_custkey", "c_name", "c_acctbal")


@query("scan_union_by_name", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus FROM orders")
def scan_union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    base, o = scratch_path(spark, "evolving"), table(spark, sf, "orders")
    o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice").write.parquet(f"{base}/a")
    o.where("o_orderkey % 2 = 1").select("o_orderstatus", "o_orderkey").write.parquet(f"{base}/b")
    return read_files(spark, [f"{base}/a", f"{base}/b"], union_by_name=True).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("scan_recursive", "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def scan_recursive(spark: SparkSession, sf: str) -> DataFrame:
    base, o = scratch_path(spark, "deep"), table(spark, sf, "orders")
    for i in range(3):
        o.where(f"o_orderkey % 3 = {i}").write.parquet(f"{base}/{'/'.join('xyz'[: i + 1])}")
    return read_files(spark, base, recursive=True, pattern="*.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("sql_source", "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def sql_source(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, {"src_customer": {"path": f"{sf}/customer.parquet"}, "src_rich": {"sql": "SELECT * FROM src_customer WHERE c_acctbal > 0"}})
    return spark.sql("SELECT c_mktsegment, COUNT(*) AS n FROM src_rich GROUP BY 1")


@query("create_table_modes", "SELECT n_nationkey, COUNT(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def create_table_modes(spark: SparkSession, sf: str) -> DataFrame:
    name, n = "modes_" + scratch_path(spark, "t").rsplit("-", 1)[1], table(spark, sf, "nation")
    n.write.saveAsTable(name)
    n.write.mode("overwrite").saveAsTable(name)
    n.where("n_regionkey = 1").write.mode("append").saveAsTable(name)
    return spark.table(name).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("optional_empty_source", "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS bonus FROM region")
def optional_empty_source(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, {
        "oes_region": {"path": f"{sf}/region.parquet"},
        "oes_bonus": {"path": f"{sf}/no_such_file.parquet", "required": False, "empty_schema": {"regionkey": "int", "bonus": "double"}},
    })
    return spark.sql("SELECT r_regionkey, r_name, bonus FROM oes_region LEFT JOIN oes_bonus ON r_regionkey = regionkey")


# Projection, casts, transforms --------------------------------------------------


@query("dataset_clean", """
SELECT c_custkey AS id, upper(c_mktsegment) AS segment, TRY_CAST(c_acctbal AS INTEGER) AS balance, c_name || '-' || CAST(c_nationkey AS VARCHAR) AS label
FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
""")
def dataset_clean(spark: SparkSession, sf: str) -> DataFrame:
    return build_dataset(table(spark, sf, "customer"), {
        "columns": [
            {"name": "id", "source": "c_custkey", "type": "BIGINT"},
            {"name": "segment", "source": "c_mktsegment", "transform": "upper", "type": "VARCHAR"},
            {"name": "balance", "source": "c_acctbal", "type": "INTEGER"},
            {"name": "label", "expression": "concat(c_name, '-', cast(c_nationkey as string))"},
        ],
        "filters": [{"column": "c_acctbal", "operator": ">", "value": 0}, {"column": "c_mktsegment", "operator": "in", "value": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}],
        "order_by": ["id"],
    })


@query("dataset_transforms", "SELECT p_partkey, trim('  ' || p_name || ' ') AS name, lower(p_brand) AS brand, upper(p_type) AS kind FROM part")
def dataset_transforms(spark: SparkSession, sf: str) -> DataFrame:
    return build_dataset(table(spark, sf, "part"), {"columns": [
        {"name": "p_partkey"}, {"name": "name", "expression": "concat('  ', p_name, ' ')", "transform": "trim"},
        {"name": "brand", "source": "p_brand", "transform": "lower"}, {"name": "kind", "source": "p_type", "transform": "upper"},
    ]})


@query("feature_transforms", "SELECT s_suppkey, abs(s_acctbal) AS size, round(s_acctbal, 1) AS rounded, lower(s_name) AS name FROM supplier")
def feature_transforms(spark: SparkSession, sf: str) -> DataFrame:
    return FE.expression_features(table(spark, sf, "supplier"), [
        {"name": "size", "source": "s_acctbal", "transform": "abs"}, {"name": "rounded", "source": "s_acctbal", "transform": "round", "decimals": 1},
        {"name": "name", "source": "s_name", "transform": "lower"},
    ]).select("s_suppkey", "size", "rounded", "name")


_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '.7' WHEN 2 THEN 'x' || CAST(o_orderkey AS VARCHAR) END"
_TEXT_SPARK = _TEXT.replace("VARCHAR", "STRING")


@query("safe_cast", f"""
SELECT o_orderkey, TRY_CAST({_TEXT} AS INTEGER) AS i, TRY_CAST({_TEXT} AS DOUBLE) AS d, TRY_CAST(o_totalprice AS BIGINT) AS b,
  TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN '1996-02-29' WHEN o_orderkey % 3 = 1 THEN 'soon' END AS DATE) AS day,
  TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'true' WHEN o_orderkey % 3 = 1 THEN 'maybe' END AS BOOLEAN) AS flag, CAST(o_custkey AS VARCHAR) AS t
FROM orders
""")
def safe_cast(spark: SparkSession, sf: str) -> DataFrame:
    return build_dataset(table(spark, sf, "orders"), {"columns": [
        {"name": "o_orderkey"}, {"name": "i", "expression": _TEXT_SPARK, "type": "INTEGER"}, {"name": "d", "expression": _TEXT_SPARK, "type": "DOUBLE"},
        {"name": "b", "source": "o_totalprice", "type": "BIGINT"},
        {"name": "day", "expression": "CASE WHEN o_orderkey % 3 = 0 THEN '1996-02-29' WHEN o_orderkey % 3 = 1 THEN 'soon' END", "type": "DATE"},
        {"name": "flag", "expression": "CASE WHEN o_orderkey % 3 = 0 THEN 'true' WHEN o_orderkey % 3 = 1 THEN 'maybe' END", "type": "BOOLEAN"},
        {"name": "t", "source": "o_custkey", "type": "VARCHAR"},
    ]})


@query("safe_cast_default", f"SELECT o_orderkey, COALESCE(TRY_CAST({_TEXT} AS INTEGER), -1) AS i, COALESCE(TRY_CAST({_TEXT} AS DOUBLE), 0.5) AS d, COALESCE({_TEXT}, 'none') AS t FROM orders")
def safe_cast_default(spark: SparkSession, sf: str) -> DataFrame:
    return build_dataset(table(spark, sf, "orders"), {"columns": [
        {"name": "o_orderkey"}, {"name": "i", "expression": _TEXT_SPARK, "type": "INTEGER", "default": -1},
        {"name": "d", "expression": _TEXT_SPARK, "type": "FLOAT", "default": 0.5}, {"name": "t", "expression": _TEXT_SPARK, "type": "VARCHAR", "default": "none"},
    ]})


@query("expr_features", f"""
SELECT {_LK.replace("l_shipdate", "CAST(l_shipdate AS DATE) AS l_shipdate")}, round(l_extendedprice / NULLIF(l_quantity, 0) + 1e-9, 6) AS unit, round(l_extendedprice / NULLIF(l_quantity, 0) * (1 - l_discount) + 1e-9, 6) AS net_unit,
  COALESCE(NULLIF(l_discount, 0), 0.01) AS discount FROM lineitem
""")
def expr_features(spark: SparkSession, sf: str) -> DataFrame:
    out = FE.build_features(table(spark, sf, "lineitem"), {"features": [
        {"name": "unit", "expression": "try_divide(l_extendedprice, l_quantity)"}, {"name": "net_unit", "expression": "round(unit * (1 - l_discount) + 1e-9D, 6)"},
        {"name": "unit", "expression": "unit + 1e-9D", "transform": "round", "decimals": 6}, {"name": "discount", "expression": "coalesce(nullif(l_discount, 0D), 0.01D)"},
    ]})
    return out.select(*LINE_KEY[:-1], F.col("l_shipdate").cast("date").alias("l_shipdate"), "unit", "net_unit", "discount")


@query("null_markers", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN o_orderstatus END AS s, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS x FROM orders")
def null_markers(spark: SparkSession, sf: str) -> DataFrame:
    s = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN 'None' ELSE o_orderstatus END")
    return X.null_markers(table(spark, sf, "orders").select("o_orderkey", s.alias("s"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("x")))


@query("auto_numeric", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS mostly, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'n/a' END AS rarely FROM orders")
def auto_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_totalprice as string) ELSE 'n/a' END").alias("mostly"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey as string) ELSE 'n/a' END").alias("rarely"))
    return X.auto_numeric(rows)


@query("one_hot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS status_F, CAST(o_orderstatus = 'O' AS INT) AS status_O, CAST(o_orderstatus = 'P' AS INT) AS status_P FROM orders")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumns(X.one_hot("o_orderstatus", ["F", "O", "P"], "status")).select("o_orderkey", "status_F", "status_O", "status_P")


@query("binning", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_bin, CAST(floor(p_retailprice / 100) AS DOUBLE) AS price_step FROM part")
def binning(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.binned("p_size", [10, 30], ["small", "middle", "large"]).alias("size_bin"), F.floor(F.col("p_retailprice") / 100).cast("double").alias("price_step"))


@query("scalar_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(pow(p_size, 1.5), 6) AS b, round(log10(p_retailprice), 6) AS c, CAST(floor(p_retailprice) AS DOUBLE) AS d, least(p_size, 20) AS e, greatest(p_size, 20) AS f, p_partkey % 7 AS g, p_retailprice / NULLIF(p_size % 2, 0) AS h FROM part")
def scalar_math(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(F.sqrt(p), 6).alias("a"), F.round(F.pow(s, F.lit(1.5)), 6).alias("b"), F.round(F.log10(p), 6).alias("c"), F.floor(p).cast("double").alias("d"),
        F.least(s, F.lit(20)).alias("e"), F.greatest(s, F.lit(20)).alias("f"), (F.col("p_partkey") % 7).alias("g"), X.safe_divide(p, s % 2).alias("h"))


@query("scalar_string", r"SELECT c_custkey, concat(c_name, NULLIF(c_mktsegment, 'BUILDING')) AS a, substring(c_name, 3, 5) AS b, regexp_extract(c_name, '[0-9]+', 0) AS c, regexp_matches(c_mktsegment, '^(B|M)') AS d, c_mktsegment LIKE '%O%' AS e, CAST(c_acctbal > 0 AS VARCHAR) AS f FROM customer")
def scalar_string(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", X.joined_text(F.col("c_name"), F.nullif(seg, F.lit("BUILDING"))).alias("a"), F.substring("c_name", 3, 5).alias("b"), F.regexp_extract("c_name", "[0-9]+", 0).alias("c"),
        seg.rlike("^(B|M)").alias("d"), seg.like("%O%").alias("e"), (F.col("c_acctbal") > 0).cast("string").alias("f"))


@query("scalar_datetime", "SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y_%m_%d') AS day_underscore, strftime(ts, '%Y%m%d') AS day_compact, CAST(ts AS DATE) - INTERVAL 1 DAY = CAST(DATE_TRUNC('month', ts) AS DATE) AS second_of_month, CAST(hour(ts) AS INT) AS h, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events")
def scalar_datetime(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", F.unix_micros(ts).alias("us"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "yyyy_MM_dd").alias("day_underscore"), F.date_format(ts, "yyyyMMdd").alias("day_compact"),
        (F.date_sub(ts.cast("date"), 1) == F.trunc(ts, "month")).alias("second_of_month"), F.hour(ts).alias("h"), F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("days"))


@query("scalar_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"type\":\"' || event_type || '\",\"id\":' || CAST(event_id AS VARCHAR) || '}' AS packed FROM events")
def scalar_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"))).alias("packed"))


@query("scalar_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def scalar_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


# Filters -----------------------------------------------------------------------


@query("filter_ops", """
SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 400000 AND o_orderkey <> 7 AND o_custkey > 2 AND o_custkey < 100000 AND o_orderstatus IN ('F', 'O')
  AND o_orderpriority NOT IN ('5-LOW') AND o_orderpriority LIKE '%-%' AND o_orderkey BETWEEN 10 AND 900000 AND o_custkey IS NOT NULL AND NOT (o_orderstatus IS NULL) AND o_orderstatus <> ''
""")
def filter_ops(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda c, o, v=None: {"column": c, "operator": o, "value": v}
    return build_dataset(table(spark, sf, "orders"), {"columns": [{"name": "o_orderkey"}], "filters": [
        f("o_totalprice", ">=", 1000), f("o_totalprice", "<=", 400000), f("o_orderkey", "!=", 7), f("o_custkey", ">", 2), f("o_custkey", "<", 100000), f("o_orderstatus", "in", ["F", "O"]),
        f("o_orderpriority", "not_in", ["5-LOW"]), f("o_orderpriority", "like", "%-%"), f("o_orderkey", "between", [10, 900000]), f("o_custkey", "is_not_null"), f("o_orderstatus", "not_empty"),
    ]})


@query("filter_allow_null", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderpriority, '1-URGENT') IS NULL OR NULLIF(o_orderpriority, '1-URGENT') = '2-HIGH'")
def filter_allow_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")))
    return rows.where(X.predicate({"column": "p", "operator": "=", "value": "2-HIGH", "allow_null": True})).select("o_orderkey")


@query("staged_filters", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice * 2 > 200000")
def staged_filters(spark: SparkSession, sf: str) -> DataFrame:
    return FE.build_features(table(spark, sf, "orders"), {
        "source_filters": [{"column": "o_orderstatus", "operator": "=", "value": "F"}], "features": [{"name": "o_orderkey", "source": "o_orderkey"}, {"name": "twice", "expression": "o_totalprice * 2"}],
        "include_source_columns": False, "final_filters": [{"column": "twice", "operator": ">", "value": 200000}]})


@query("quality_rules", "SELECT p_partkey FROM part WHERE p_name IS NOT NULL AND p_brand <> '' AND p_size BETWEEN 5 AND 40 AND CAST(p_retailprice AS DOUBLE) >= 901 AND regexp_matches(p_brand, '#[1-4]') AND length(p_type) > 3")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return FE.apply_quality(table(spark, sf, "part"), [
        {"type": "not_null", "column": "p_name"}, {"type": "not_empty", "column": "p_brand"}, {"type": "range", "column": "p_size", "min": 5, "max": 40},
        {"type": "range", "column": "p_retailprice", "min": 901, "cast": "numeric"}, {"type": "regex", "column": "p_brand", "pattern": "#[1-4]"}, {"type": "custom", "expression": "length(p_type) > 3"},
    ]).select("p_partkey")


@query("quality_unique", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def quality_unique(spark: SparkSession, sf: str) -> DataFrame:
    return FE.apply_quality(table(spark, sf, "orders"), [{"type": "unique", "column": "o_custkey", "order_by": ["o_orderkey"]}]).select("o_custkey", "o_orderkey")


@query("param_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND o_totalprice BETWEEN 1000 AND 300000 AND (o_custkey % 2 = 1 OR o_orderpriority = '1-URGENT')")
def param_filters(spark: SparkSession, sf: str) -> DataFrame:
    cond, _ = X.param_filters(
        [{"column": "o_orderstatus", "operator": "IN", "param": "states", "aliases": ["status"]}, {"column": "o_orderdate", "operator": ">=", "param": "since", "type": "date"},
         {"column": "o_totalprice", "operator": "BETWEEN", "param": "price", "type": "float"}, {"column": "o_custkey", "param": "customer", "type": "int"}],
        {"status": ["F", "P"], "since": "1996-01-01", "price": ["1000", 300000], "rest": 1, "urgent": "1-URGENT"}, "(o_custkey % 2 = {rest} OR o_orderpriority = {urgent})", ["rest"])
    return table(spark, sf, "orders").where(cond).select("o_orderkey")


# Joins ---------------------------------------------------------------------------


def _sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All orders and customers; some keys are moved out of range, so that both sides have rows without a partner."""
    orders = table(spark, sf, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_custkey % 3 = 0 THEN -o_custkey ELSE o_custkey END"))
    customers = table(spark, sf, "customer").withColumn("c_custkey", F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END"))
    return {"o": orders, "c": customers, "n": table(spark, sf, "nation")}


_O = "(SELECT * REPLACE (CASE WHEN o_custkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey) FROM orders)"
_C = "(SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey) FROM customer)"


def _merged(spark: SparkSession, sf: str, how: str) -> DataFrame:
    return merge_sources(_sources(spark, sf), {
        "sources": [{"name": "o"}, {"name": "c"}], "join": {"type": how, "on": [{"left": "o.o_custkey", "right": "c.c_custkey"}]},
        "columns": [{"name": "o_orderkey", "source": "o"}, {"name": "c_custkey", "source": "c"}, {"name": "segment", "source": "c", "column": "c_mktsegment", "type": "VARCHAR", "default": "none"}]})


def _merge_sql(how: str) -> str:
    return f"SELECT o_orderkey, c_custkey, COALESCE(c_mktsegment, 'none') AS segment FROM {_O} {how} JOIN {_C} ON o_custkey = c_custkey"


for _how, _sql in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("outer", "FULL")):
    query(f"merge_{'full' if _how == 'outer' else _how}", _merge_sql(_sql))(lambda spark, sf, how=_how: _merged(spark, sf, how))


@query("merge_multi", f"SELECT o_orderkey, c_name, n_name, CAST(round_even(o_totalprice, 0) AS INT) AS price FROM {_O} LEFT JOIN {_C} ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def merge_multi(spark: SparkSession, sf: str) -> DataFrame:
    return merge_sources(_sources(spark, sf), {
        "sources": [{"name": "o"}, {"name": "c", "join": {"type": "left", "on": [{"left": "o.o_custkey", "right": "c.c_custkey"}]}}, {"name": "n", "join": {"type": "left", "on": [{"left": "c.c_nationkey", "right": "n.n_nationkey"}]}}],
        "columns": [{"name": "o_orderkey", "source": "o"}, {"name": "c_name", "source": "c"}, {"name": "n_name", "source": "n"}, {"name": "price", "source": "o", "column": "o_totalprice", "type": "INTEGER"}]})


# Aggregates ------------------------------------------------------------------------

_METRICS = [{"name": "n", "function": "COUNT"}, {"name": "avg_qty", "function": "AVG", "column": "l_quantity"}, {"name": "sum_price", "function": "SUM", "column": "l_extendedprice"},
            {"name": "min_disc", "function": "MIN", "column": "l_discount"}, {"name": "max_tax", "function": "MAX", "column": "l_tax"}, {"name": "sd_qty", "function": "STDDEV", "column": "l_quantity"}]
_AGG_SQL = "COUNT(*) AS n, round(AVG(l_quantity), 6) AS avg_qty, round(SUM(l_extendedprice), 2) AS sum_price, MIN(l_discount) AS min_disc, MAX(l_tax) AS max_tax, round(STDDEV(l_quantity), 6) AS sd_qty"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"avg_qty": F.round("avg_qty", 6), "sum_price": F.round("sum_price", 2), "sd_qty": F.round("sd_qty", 6)})


@query("agg_features", f"SELECT l_returnflag, l_linestatus, {_AGG_SQL} FROM lineitem GROUP BY 1, 2")
def agg_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(FE.build_features(table(spark, sf, "lineitem"), {"aggregations": {"group_by": ["l_returnflag", "l_linestatus"], "metrics": _METRICS}}))


@query("agg_global", f"SELECT {_AGG_SQL} FROM lineitem")
def agg_global(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(FE.build_features(table(spark, sf, "lineitem"), {"aggregations": {"metrics": _METRICS}}))


@query("agg_join_back", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS orders, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def agg_join_back(spark: SparkSession, sf: str) -> DataFrame:
    m = [{"name": "orders", "function": "COUNT"}, {"name": "top", "function": "MAX", "column": "o_totalprice"}]
    return FE.build_features(table(spark, sf, "orders"), {"aggregations": {"group_by": ["o_custkey"], "metrics": m, "mode": "join_back"}}).select("o_orderkey", "orders", "top")


@query("sql_rollup_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ()) HAVING COUNT(*) > 10")
def sql_rollup_cube(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("src_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers FROM src_lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING COUNT(*) > 10")


@query("sql_set_ops", "(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def sql_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.select(F.col("c_custkey").alias("k")).intersect(o.select("o_custkey")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


# Windows -----------------------------------------------------------------------------


def _windowed(spark: SparkSession, sf: str, *specs: dict) -> DataFrame:
    by = {"partition_by": ["o_custkey"]}
    out = FE.build_features(table(spark, sf, "orders"), {"window_features": [by | s for s in specs]})
    return out.select("o_orderkey", *[s["name"] for s in specs])


_BY_DATE = {"order_by": ["o_orderdate", "o_orderkey"]}
_OVER = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query("window_avg", "SELECT o_orderkey, round(AVG(o_totalprice) OVER (PARTITION BY o_custkey) + 1e-7, 4) AS mean FROM orders")
def window_avg(spark: SparkSession, sf: str) -> DataFrame:
    return _windowed(spark, sf, {"name": "mean", "function": "avg", "column": "o_totalprice"}).withColumn("mean", F.round(F.col("mean") + 1e-7, 4))


@query("window_running_sum", f"SELECT o_orderkey, round(SUM(o_totalprice) OVER {_OVER}, 2) AS running FROM orders")
def window_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _windowed(spark, sf, {"name": "running", "function": "sum", "column": "o_totalprice", **_BY_DATE}).withColumn("running", F.round("running", 2))


@query("window_ranking", """
SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, RANK() OVER w AS rk, DENSE_RANK() OVER w AS dr, round(PERCENT_RANK() OVER w, 6) AS pr, round(CUME_DIST() OVER w, 6) AS cd
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def window_ranking(spark: SparkSession, sf: str) -> DataFrame:
    p = {"order_by": ["o_orderpriority"]}
    out = _windowed(spark, sf, {"name": "rn", "function": "row_number", **_BY_DATE}, *[{"name": n, "function": f, **p} for n, f in (("rk", "rank"), ("dr", "dense_rank"), ("pr", "percent_rank"), ("cd", "cume_dist"))])
    return out.withColumns({"pr": F.round("pr", 6), "cd": F.round("cd", 6)})


@query("window_ntile", f"SELECT o_orderkey, NTILE(4) OVER {_OVER} AS quarter FROM orders")
def window_ntile(spark: SparkSession, sf: str) -> DataFrame:
    return _windowed(spark, sf, {"name": "quarter", "function": "ntile", "n": 4, **_BY_DATE})


@query("window_count", f"SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, COUNT(*) OVER {_OVER} AS nth FROM orders")
def window_count(spark: SparkSession, sf: str) -> DataFrame:
    return _windowed(spark, sf, {"name": "n", "function": "count"}, {"name": "nth", "function": "count", **_BY_DATE})


@query("global_rank", "SELECT p_partkey, RANK() OVER w AS \"rank\", DENSE_RANK() OVER w AS \"dense_rank\", round(PERCENT_RANK() OVER w, 8) AS \"percent_rank\", round(CUME_DIST() OVER w, 8) AS \"cume_dist\" FROM part WINDOW w AS (ORDER BY p_retailprice DESC NULLS LAST)")
def global_ranks(spark: SparkSession, sf: str) -> DataFrame:
    out = global_rank(table(spark, sf, "part"), ["p_retailprice DESC"])
    return out.select("p_partkey", "rank", "dense_rank", F.round("percent_rank", 8).alias("percent_rank"), F.round("cume_dist", 8).alias("cume_dist"))


@query("order_nulls_last", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS k FROM orders ORDER BY k NULLS LAST, o_orderkey DESC")
def order_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("k"))
    return rows.orderBy(*X.ordering(["k", "o_orderkey DESC"]))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return FE.build_features(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), {"order_by": ["o_totalprice DESC", "o_orderkey"], "limit": 20})


@query("dedupe_keep_last", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    from tidemill.operators.incremental import keep_last

    return keep_last(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


# Look-back features ---------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_ALL = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _last(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _even(c: str) -> Column:
    """Rounded; the small shift lets exact halves go up in every engine."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


def _history(spark: SparkSession, sf: str, *features: dict, **options: str) -> DataFrame:
    out = EVENTS.build(table(spark, sf, "events"), [list(features)], **options)
    new = [c for c in out.columns if c not in ("event_id", "ts", "user_id", "event_type", "value", "props")]
    kinds = dict(out.dtypes)
    return out.select("event_id", *[_even(c) if kinds[c] == "double" else F.col(c) for c in new])


@query("hist_count", f"SELECT event_id, COUNT(*) OVER {_ALL} AS seen FROM events")
def hist_count(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, {"type": "count", "name": "seen"})


@query("hist_aggs", "SELECT event_id, " + ", ".join(f"round({f}(value) OVER {_ALL} + 1e-9, 6) AS {n}" for n, f in (("mean", "AVG"), ("total", "SUM"), ("high", "MAX"), ("low", "MIN"), ("sd", "STDDEV_SAMP"))) + " FROM events")
def hist_aggs(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, *[{"type": t, "name": n, "expression": "value"} for n, t in (("mean", "average"), ("total", "sum"), ("high", "max"), ("low", "min"), ("sd", "stddev"))])


@query("hist_last_n", f"SELECT event_id, round(AVG(value) OVER {_last(3)} + 1e-9, 6) AS mean_last_3, round(AVG(value) OVER {_last(5)} + 1e-9, 6) AS mean_last_5, COUNT(*) OVER {_last(5)} AS recent FROM events")
def hist_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, {"type": "average", "name": "mean", "expression": "value", "windows": ["last_3", "last_5"]}, {"type": "count", "name": "recent", "window": "last_5"})


@query("hist_filtered", f"SELECT event_id, COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) OVER {_ALL} AS bought, round(SUM(CASE WHEN event_type = 'purchase' THEN value END) OVER {_ALL} + 1e-9, 6) AS spent FROM events")
def hist_filtered(spark: SparkSession, sf: str) -> DataFrame:
    f = "event_type = 'purchase'"
    return _history(spark, sf, {"type": "count", "name": "bought", "filter": f}, {"type": "sum", "name": "spent", "expression": "value", "filter": f})


@query("hist_partitioned", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_type FROM events")
def hist_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, {"type": "count", "name": "same_type", "partition_by": ["event_type"]})


@query("time_since_last", f"SELECT event_id, round((epoch_us(ts) - LAG(epoch_us(ts)) OVER ({_W})) / 86400000000.0 + 1e-9, 6) AS gap FROM events")
def time_since_last(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, {"type": "time_since_last_event", "name": "gap"})


@query("is_first_time", "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh FROM events")
def is_first_time(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, {"type": "is_first_time", "name": "fresh", "context": ["event_type"]})


@query("diff_from_last", f"SELECT event_id, round(value - LAG(value) OVER ({_W}) + 1e-9, 6) AS step FROM events")
def diff_from_last(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, {"type": "diff_from_last", "name": "step", "expression": "value"})


_LINES = History("l_partkey", "l_shipdate", ["l_orderkey", "l_linenumber", "l_suppkey"])
_CONTEXT = "PARTITION BY l_suppkey, DATE_TRUNC('month', l_shipdate)"


def _context(spark: SparkSession, sf: str, lagged: bool) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    out = _LINES.build(rows, [[{"type": "contextual_delta_from_min", "name": "delta", "expression": "l_extendedprice", "filter": "l_quantity > 5", "context": ["l_suppkey", "month"], "lagged": lagged}]])
    return out.select(*LINE_KEY[:-1], F.col("l_shipdate").cast("date").alias("l_shipdate"), F.round("delta", 4).alias("delta"))


_DELTA = f"l_extendedprice - MIN(CASE WHEN l_quantity > 5 THEN l_extendedprice END) OVER ({_CONTEXT})"
_KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate"


@query("context_delta", f"SELECT {_KEYS_SQL}, round({_DELTA}, 4) AS delta FROM lineitem")
def context_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf, False)


@query("context_delta_lagged", f"SELECT {_KEYS_SQL}, round(LAG(d) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey), 4) AS delta FROM (SELECT *, {_DELTA} AS d FROM lineitem)")
def context_delta_lagged(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf, True)


@query("multi_pass_features", f"""
WITH one AS (SELECT *, AVG(value) OVER {_ALL} AS mean FROM events), two AS (SELECT *, value - mean AS surprise FROM one)
SELECT event_id, round(mean + 1e-9, 6) AS mean, round(surprise + 1e-9, 6) AS surprise, round(MAX(surprise) OVER {_ALL} + 1e-9, 6) AS top_surprise FROM two
""")
def multi_pass_features(spark: SparkSession, sf: str) -> DataFrame:
    first = [{"type": "average", "name": "mean", "expression": "value"}, {"type": "derived", "name": "surprise", "expression": "value - mean"}]
    out = EVENTS.build(table(spark, sf, "events"), [first, [{"type": "max", "name": "top_surprise", "expression": "surprise"}]])
    return out.select("event_id", *[_even(c) for c in ("mean", "surprise", "top_surprise")])


@query("predicate_pre_window", f"SELECT event_id, seen FROM (SELECT *, COUNT(*) OVER {_ALL} AS seen FROM events WHERE value > 20) WHERE event_type = 'click'")
def predicate_pre_window(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf, {"type": "count", "name": "seen"}, predicate="value > 20", post_predicate="event_type = 'click'")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned events with each user's history."""
    rows = table(spark, sf, "events").where("value > 0")
    out = EVENTS.build(rows, [[
        {"type": "count", "name": "seen"}, {"type": "average", "name": "mean", "expression": "value", "windows": ["all_time", "last_5", "last_3"]},
        {"type": "time_since_last_event", "name": "gap"}, {"type": "is_first_time", "name": "fresh", "context": ["event_type"]},
    ]])
    return out.select("event_id", "seen", *[_even(c) for c in ("mean_all_time", "mean_last_5", "mean_last_3", "gap")], "fresh")


query("entity_history", f"""
SELECT event_id, COUNT(*) OVER {_ALL} AS seen, round(AVG(value) OVER {_ALL} + 1e-9, 6) AS mean_all_time, round(AVG(value) OVER {_last(5)} + 1e-9, 6) AS mean_last_5, round(AVG(value) OVER {_last(3)} + 1e-9, 6) AS mean_last_3,
  round((epoch_us(ts) - LAG(epoch_us(ts)) OVER ({_W})) / 86400000000.0 + 1e-9, 6) AS gap, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh
FROM events WHERE value > 0
""")(flagship)


# Catalogue ------------------------------------------------------------------------


@query("load_dataset", "SELECT o_orderkey, 'name' AS via FROM orders UNION ALL SELECT o_orderkey, 'path' FROM orders UNION ALL SELECT o_orderkey, 'folder' FROM orders")
def load_dataset(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("ld_orders")
    found = [("name", R.load_dataset(spark, "ld_orders")), ("path", R.load_dataset(spark, f"{sf}/orders.parquet")), ("folder", R.load_dataset(spark, "orders", base=sf))]
    parts = [df.select("o_orderkey", F.lit(via).alias("via")) for via, df in found]
    return parts[0].union(parts[1]).union(parts[2])


@query("list_relations", "SELECT name, CAST(count(*) AS BIGINT) AS \"rows\" FROM (SELECT 'lr_nation' AS name FROM nation UNION ALL SELECT 'lr_orders' FROM orders) GROUP BY 1")
def list_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The registered relations by name, with the rows of each."""
    for name in ("orders", "nation"):
        table(spark, sf, name).createOrReplaceTempView(f"lr_{name}")
    names = R.relations(spark, "lr_*").select("name")
    counts = spark.table("lr_orders").select(F.lit("lr_orders").alias("name")).union(spark.table("lr_nation").select(F.lit("lr_nation").alias("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    return names.join(counts, "name")


@query("preview_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), order_by=["o_orderkey"])


@query("empty_feature", "SELECT o_orderkey, o_totalprice * 2 AS twice, CAST(NULL AS DOUBLE) AS nothing FROM orders")
def empty_feature(spark: SparkSession, sf: str) -> DataFrame:
    """A feature without an expression is a column of nulls."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = FE.build_features(rows, {"include_source_columns": True, "features": [{"name": "twice", "expression": "o_totalprice * 2"}, {"name": "nothing"}]})
    return out.select("o_orderkey", "twice", F.col("nothing").cast("double").alias("nothing"))
