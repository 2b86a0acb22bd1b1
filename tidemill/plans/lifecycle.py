"""Queries of sinks, tables, rollups, slices, incremental refresh and streams. What an operator writes is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import partition_segment
from tidemill.operators import incremental as I
from tidemill.operators.history import History
from tidemill.operators.maintained import AggregateView, take_changes
from tidemill.operators.steps import run_step
from tidemill.operators.tables import DatedTable, expected_files, rollup, rollup_tiers
from tidemill.plans.registry import query, table
from tidemill.sources import readers as R
from tidemill.sources import writers as W
from tidemill.sources.scratch import make_dir, rename_path, scratch_path, stored
from tidemill.streaming import streams as S

# Sinks -----------------------------------------------------------------------


@query("write_sorted_roundtrip", "SELECT o_orderkey, o_totalprice FROM orders")
def write_sorted_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sorted")
    W.write_output(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, sort_by=["o_totalprice DESC", "o_orderkey"])
    return R.read_files(spark, path)


_STATUS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


@query("write_replace_partition", "SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END AS o_totalprice, CAST(o_orderkey % 4 AS INT) AS bucket FROM orders WHERE o_orderkey % 4 <> 2")
def write_replace_partition(spark: SparkSession, sf: str) -> DataFrame:
    path, o = scratch_path(spark, "buckets"), table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    W.write_partitioned(o.where("o_orderkey % 4 <> 2"), path, expression="cast(o_orderkey % 4 as int)", column="bucket", sort_by=["o_orderkey"])
    W.write_partitioned(o.where("o_orderkey % 4 = 1").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, expression="cast(o_orderkey % 4 as int)", column="bucket", atomic=True)
    return R.read_files(spark, path)


@query("write_append_partition", f"{_STATUS} UNION ALL {_STATUS} WHERE o_orderstatus = 'F'")
def write_append_partition(spark: SparkSession, sf: str) -> DataFrame:
    path, o = scratch_path(spark, "append"), table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    W.write_partitioned(o, path, by="o_orderstatus", mode="append")
    W.write_partitioned(o.where("o_orderstatus = 'F'"), path, by="o_orderstatus", mode="append")
    return R.read_files(spark, path)


@query("partition_segment", r"""
SELECT segment, COUNT(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN '__null__' WHEN trim(v) = '' THEN '__empty__' ELSE regexp_replace(v, '[^A-Za-z0-9._-]', '_', 'g') END AS segment
FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE o_orderpriority || '/' || o_orderstatus END AS v FROM orders)) GROUP BY 1
""")
def partition_segments(spark: SparkSession, sf: str) -> DataFrame:
    v = F.expr("CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat(o_orderpriority, '/', o_orderstatus) END")
    path = scratch_path(spark, "segments")
    W.write_partitioned(table(spark, sf, "orders").select("o_orderkey", partition_segment(v).alias("segment")), path, by="segment")
    return R.read_files(spark, path).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("rollup_formats", "SELECT 'csv' AS fmt, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'jsonl', COUNT(*), CAST(SUM(o_orderkey) AS BIGINT) FROM orders UNION ALL SELECT 'parquet', COUNT(*), CAST(SUM(o_orderkey) AS BIGINT) FROM orders")
def rollup_formats(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for fmt in ("csv", "jsonl", "parquet"):
        target = scratch_path(spark, f"rollup-{fmt}")
        rollup(spark, f"{sf}/orders.parquet", target, out_fmt=fmt, gzip=fmt != "parquet")
        df = R.read_files(spark, target, fmt).agg(F.lit(fmt).alias("fmt"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("bigint").alias("total"))
        out = df if out is None else out.unionByName(df)
    return out


@query("rollup_skip_existing", "SELECT 'written' AS first_run, 'skipped' AS second_run, COUNT(*) AS n FROM supplier")
def rollup_skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "rollup")
    a, b = (rollup(spark, f"{sf}/supplier.parquet", target)["status"] for _ in range(2))
    return R.read_files(spark, target).agg(F.lit(a).alias("first_run"), F.lit(b).alias("second_run"), F.count(F.lit(1)).alias("n"))


@query("run_log_summary", "SELECT 'success' AS status, COUNT(*) AS runs, CAST(SUM(n) AS BIGINT) AS \"rows\" FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_orderstatus)")
def run_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    for r in table(spark, sf, "orders").groupBy("o_orderstatus").count().collect():  # a row for each run
        W.append_events(spark, path, [{"workflow": "orders", "run_id": r[0], "event_type": "step", "status": "success", "rows": r[1]}])
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"))


# Tables, slices and rollups ---------------------------------------------------------


def _daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value", F.col("ts").cast("date").alias("day"))


@query("table_ingest", "SELECT CAST(ts AS DATE) AS dt, COUNT(*) AS n, round(SUM(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-03' THEN 2 * value ELSE value END), 4) AS total FROM events GROUP BY 1")
def table_ingest(spark: SparkSession, sf: str) -> DataFrame:
    t, rows = DatedTable(spark, "ev", scratch_path(spark, "table")), _daily_orders(spark, sf)
    t.ingest_all(rows, "day")
    t.ingest(rows.where("day = date'2024-01-03'").withColumn("value", F.col("value") * 2), "2024-01-03")
    return t.read().groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("table_query", "SELECT CAST(day(ts) AS INT) AS d, COUNT(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def table_query(spark: SparkSession, sf: str) -> DataFrame:
    t = DatedTable(spark, "ev_query", scratch_path(spark, "table"))
    t.ingest_all(_daily_orders(spark, sf), "day")
    return t.query("SELECT day(dt) AS d, COUNT(*) AS n FROM ev_query WHERE value > 10 GROUP BY 1")


@query("daily_revenue", "SELECT CAST(ts AS DATE) AS dt, round(SUM(value), 4) AS revenue, COUNT(*) AS sales FROM events WHERE event_type = 'purchase' GROUP BY 1")
def daily_revenue(spark: SparkSession, sf: str) -> DataFrame:
    t = DatedTable(spark, "ev_sales", scratch_path(spark, "table"))
    t.ingest_all(table(spark, sf, "events").select("event_type", "value", F.col("ts").cast("date").alias("day")), "day")
    return t.query("SELECT dt, round(SUM(value), 4) AS revenue, COUNT(*) AS sales FROM ev_sales WHERE event_type = 'purchase' GROUP BY dt")


@query("table_status", "SELECT 'ev' AS tbl, COUNT(DISTINCT CAST(ts AS DATE)) AS days, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, COUNT(*) AS \"rows\", CAST(1 AS BIGINT) AS compactions, '2024-01' AS first_month, '2024-01' AS last_month FROM events")
def table_status(spark: SparkSession, sf: str) -> DataFrame:
    t = DatedTable(spark, "ev", scratch_path(spark, "table"))
    t.ingest_all(_daily_orders(spark, sf), "day")
    t.compact("2024-01")
    return t.status().withColumnRenamed("table", "tbl")


@query("compact_month", "SELECT event_id, value, CAST(ts AS DATE) AS dt FROM events")
def compact_month(spark: SparkSession, sf: str) -> DataFrame:
    t = DatedTable(spark, "ev", scratch_path(spark, "table"))
    t.ingest_all(_daily_orders(spark, sf), "day")
    t.compact("2024-01")
    return t.read().select("event_id", "value", "dt")


@query("compact_late_day", """
WITH r AS (SELECT event_id, value, CAST(ts AS DATE) AS dt FROM events)
SELECT event_id, CASE WHEN day(dt) = 3 THEN value * 2 WHEN day(dt) = 5 THEN value + 1 ELSE value END AS value, dt FROM r
""")
def compact_late_day(spark: SparkSession, sf: str) -> DataFrame:
    """Every month is compacted, its daily files removed; then a late day comes, one is ingested anew, and months are compacted again."""
    t, rows = DatedTable(spark, "ev", scratch_path(spark, "table"), date_format="yyyyMMdd"), _daily_orders(spark, sf)
    t.ingest_all(rows.where("day(day) <> 7"), "day")
    months = [r[0] for r in rows.select(F.date_format("day", "yyyy-MM").alias("m")).distinct().orderBy("m").collect()]  # a row a month
    for m in months:
        t.compact(m, delete=True)
    t.ingest_all(rows.where("day(day) in (3, 7)").withColumn("value", F.expr("CASE WHEN day(day) = 3 THEN value * 2 ELSE value END")), "day")
    for m in months:
        t.compact(m)
    t.ingest_all(rows.where("day(day) = 5").withColumn("value", F.col("value") + 1), "day")
    return t.read().select("event_id", "value", "dt")


@query("ingest_from_source", "SELECT CAST(min(CAST(ts AS DATE)) AS DATE) AS dt, COUNT(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) AND event_type = 'click'")
def ingest_from_source(spark: SparkSession, sf: str) -> DataFrame:
    """A source function is called with the date and its own parameters."""
    e = table(spark, sf, "events")

    def clicks(date: str, kind: str) -> DataFrame:
        return e.where((F.to_date("ts") == F.lit(date).cast("date")) & (F.col("event_type") == kind)).select("event_id", "value")

    t = DatedTable(spark, "clicks", scratch_path(spark, "table"))
    t.ingest_from(clicks, str(e.agg(F.min(F.to_date("ts"))).first()[0]), kind="click", unused=1)
    return t.read().groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query("run_step", "SELECT user_id, COUNT(*) AS n FROM events WHERE value > 20 GROUP BY 1")
def python_step(spark: SparkSession, sf: str) -> DataFrame:
    def busy(rows: DataFrame, least: float) -> DataFrame:
        return rows.where(F.col("value") > least).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    return run_step(busy, {"rows": table(spark, sf, "events"), "least": 20, "other": None})


_FILES = """SELECT DISTINCT 'events' AS "table", 'data_' || strftime(ts, '%Y_%m_%d') || '.parquet' AS key FROM events WHERE day(ts) % 2 = 0
UNION ALL SELECT DISTINCT 'events', 'data_' || strftime(ts, '%Y_%m') || '.parquet' FROM events UNION ALL SELECT DISTINCT 'events', 'data_' || strftime(ts, '%Y') || '.parquet' FROM events"""


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    name = lambda f: F.concat(F.lit("data_"), F.date_format("ts", f), F.lit(".parquet")).alias("key")
    days = e.where("day(ts) % 2 = 0").select(name("yyyy_MM_dd")).distinct()
    keys = days.union(e.select(name("yyyy_MM")).distinct()).union(e.select(name("yyyy")).distinct())
    return stored(R.with_tier(keys.select(F.lit("events").alias("table"), "key")), "catalogue")


@query("infer_tier_from_key", f"""
WITH f AS ({_FILES}), p AS (SELECT *, regexp_extract(key, '_([0-9_]+)[.]parquet$', 1) AS s FROM f)
SELECT key, CASE length(s) WHEN 10 THEN 'daily' WHEN 7 THEN 'monthly' ELSE 'yearly' END AS tier,
  CASE length(s) WHEN 10 THEN CAST(strptime(s, '%Y_%m_%d') AS DATE) WHEN 7 THEN CAST(strptime(s, '%Y_%m') AS DATE) ELSE CAST(s || '-01-01' AS DATE) END AS start_date,
  CASE length(s) WHEN 10 THEN CAST(strptime(s, '%Y_%m_%d') AS DATE) WHEN 7 THEN last_day(CAST(strptime(s, '%Y_%m') AS DATE)) ELSE CAST(s || '-12-31' AS DATE) END AS end_date FROM p
""")
def infer_tier_from_key(spark: SparkSession, sf: str) -> DataFrame:
    return _catalogue(spark, sf).select("key", "tier", "start_date", "end_date")


@query("resolve_slices", """
SELECT DISTINCT CAST(ts AS DATE) AS "date", CASE WHEN day(ts) % 2 = 0 THEN 'data_' || strftime(ts, '%Y_%m_%d') || '.parquet' ELSE 'data_' || strftime(ts, '%Y_%m') || '.parquet' END AS key FROM events
""")
def resolve_slices(spark: SparkSession, sf: str) -> DataFrame:
    dates = table(spark, sf, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    return R.resolve_slices(_catalogue(spark, sf), dates, "daily").select("date", "key")


@query("read_slices", "SELECT event_id, value, CAST(ts AS DATE) AS day FROM events WHERE day(ts) BETWEEN 5 AND 12")
def read_slices(spark: SparkSession, sf: str) -> DataFrame:
    base, e = scratch_path(spark, "tiers"), _daily_orders(spark, sf)
    W.write_output(e, f"{base}/data_2024_01.parquet")
    for d in (6, 8, 10):
        W.write_output(e.where(F.dayofmonth("day") == d), f"{base}/data_2024_01_{d:02d}.parquet")
    keys = spark.createDataFrame([("t", k) for k in ["data_2024_01.parquet", *[f"data_2024_01_{d:02d}.parquet" for d in (6, 8, 10)]]], "table string, key string")
    days = e.select(F.col("day").alias("date")).where(F.dayofmonth("day").between(5, 12)).distinct()
    return R.read_slices(spark, base, R.resolve_slices(R.with_tier(keys), days), "day").select("event_id", "value", "day")


@query("profile_read", "SELECT COUNT(*) AS n, 'serving' AS layout FROM orders WHERE o_orderstatus = 'O'")
def profile_read(spark: SparkSession, sf: str) -> DataFrame:
    base, o = scratch_path(spark, "profiles"), table(spark, sf, "orders")
    W.write_output(o.withColumn("layout", F.lit("raw")), f"{base}/raw")
    W.write_output(o.where("o_orderstatus = 'O'").withColumn("layout", F.lit("serving")), f"{base}/serving")
    spec = {"storage": {"local": f"{base}/raw"}, "profiles": {"serving_entity": {"local": f"{base}/gone", "remote": f"{base}/serving"}}}
    return R.read_files(spark, R.profile_path(spark, spec, "features")).groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


@query("rollup_simple", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS price FROM orders")
def rollup_simple(spark: SparkSession, sf: str) -> DataFrame:
    base, target = scratch_path(spark, "many"), scratch_path(spark, "one")
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 > 0 THEN cast(o_totalprice as string) ELSE 'NaN' END").alias("price"))
    rows.repartition(4, "o_orderkey").write.option("compression", "gzip").json(base)
    rollup(spark, base, target, "jsonl", pattern="*.gz")
    return R.read_files(spark, target).select("o_orderkey", "price")


@query("rollup_completeness", "SELECT strftime(o_orderdate, '%Y-%m') AS \"month\", COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS days, day(last_day(min(CAST(o_orderdate AS DATE)))) AS expected FROM orders GROUP BY 1")
def rollup_completeness(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_distinct(F.col("o_orderdate").cast("date")).alias("days"))
    months = [r[0] for r in days.select("month").distinct().collect()]  # a row a month
    table_of = spark.createDataFrame([(m, expected_files("monthly", m)) for m in months], "m string, expected bigint")
    return days.join(table_of, F.col("month") == F.col("m")).select("month", "days", "expected")


@query("rollup_hierarchical", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1")
def rollup_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    base, e = scratch_path(spark, "tiers"), _daily_orders(spark, sf)
    W.write_partitioned(e.withColumn("file", F.concat(F.lit("data_"), F.date_format("day", "yyyy_MM_dd"))), f"{base}/parts", by="file")
    make_dir(spark, f"{base}/daily")
    for d in [r[0] for r in e.select("day").distinct().collect()]:  # a row a day
        rename_path(spark, f"{base}/parts/file=data_{d:%Y_%m_%d}", f"{base}/daily/data_{d:%Y_%m_%d}")
    months = [(r[0], r[1]) for r in e.select(F.year("day"), F.month("day")).distinct().collect()]  # a row a month
    years = sorted({y for y, _ in months})
    rollup_tiers(spark, base, "{tier}/data_{period}", years, {y: sorted(m for x, m in months if x == y) for y in years})
    return R.read_files(spark, [f"{base}/yearly/data_{y}" for y in years]).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Incremental refresh ------------------------------------------------------------------


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change feed made of events: a key map for each event, some with idempotency keys."""
    e = table(spark, sf, "events")
    m = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv]), F.array(*[v.cast("string") for v in kv.values()]))
    return I.change_events(e.select(
        F.lit("events").alias("source"), F.when(F.col("event_id") % 3 == 0, F.lit("delete")).alias("change_type"),
        m(user_id=F.col("user_id"), event_type=F.col("event_type")).alias("primary_key"), m(day=F.to_date("ts")).alias("partition_keys"), m(user_id=F.col("user_id")).alias("entity_keys"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("idempotency_key"), "event_id",
    ))


@query("change_events", "SELECT event_id, 'events' AS source_name, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'upsert' END AS change_type, CAST(user_id AS VARCHAR) AS u, strftime(ts, '%Y-%m-%d') AS d FROM events")
def change_events(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("event_id", "source_name", "change_type", F.col("entity_keys")["user_id"].alias("u"), F.col("partition_keys")["day"].alias("d"))


@query("change_ids", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE 'events:' || CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'upsert' END || ':{"event_type":"' || event_type || '","user_id":"' || user_id || '"}' END AS id FROM events""")
def change_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("event_id", I.change_id().alias("id"))


@query("affected_keys", """SELECT DISTINCT 'slices' AS node, 'partition' AS grain, '{"day":"' || strftime(ts, '%Y-%m-%d') || '","user_id":"' || user_id || '"}' AS key_json FROM events""")
def affected_keys(spark: SparkSession, sf: str) -> DataFrame:
    return I.affected_keys(_changes(spark, sf), "slices", "partition", ["day", "user_id"]).select("node", "grain", "key_json")


_EDGES = [
    {"from": "rows", "to": "users", "mode": "entity", "key_mapping": {"user_id": "user_id"}}, {"from": "rows", "to": "days", "mode": "partition", "key_mapping": {"day": "day"}},
    {"from": "users", "to": "report", "mode": "key", "key_mapping": {"user_id": "who"}}, {"from": "days", "to": "report", "mode": "key", "key_mapping": {"day": "when"}},
]


@query("propagate_changes", """
WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u, strftime(ts, '%Y-%m-%d') AS d FROM events)
SELECT 'rows' AS node, 'key' AS grain, '{"day":"' || d || '","user_id":"' || u || '"}' AS key_json FROM u
UNION ALL SELECT DISTINCT 'users', 'entity', '{"user_id":"' || u || '"}' FROM u UNION ALL SELECT DISTINCT 'days', 'partition', '{"day":"' || d || '"}' FROM u
UNION ALL SELECT DISTINCT 'report', 'key', '{"who":"' || u || '"}' FROM u UNION ALL SELECT DISTINCT 'report', 'key', '{"when":"' || d || '"}' FROM u
""")
def propagate_changes(spark: SparkSession, sf: str) -> DataFrame:
    return I.propagate(I.affected_keys(_changes(spark, sf), "rows", "key", ["day", "user_id"]), _EDGES).select("node", "grain", "key_json")


@query("touched_partitions", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'")
def touched_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return I.touched(table(spark, sf, "events").where("event_type = 'error'").withColumn("day", F.to_date("ts")), "day")


@query("partition_replace", "SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN value + 1 ELSE value END AS value, CAST(ts AS DATE) AS day FROM events")
def partition_replace(spark: SparkSession, sf: str) -> DataFrame:
    path, e = scratch_path(spark, "parts"), _daily_orders(spark, sf)
    I.partition_replace(e, path, "day")
    I.partition_replace(e.where("day = date'2024-01-05'").withColumn("value", F.col("value") + 1), path, "day")
    return R.read_files(spark, path)


_UPSERT = """
SELECT user_id, day, arg_max(event_id, event_id) AS event_id, arg_max(v, event_id) AS value FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id, CASE WHEN event_type = 'click' THEN value * 10 ELSE value END AS v, event_type FROM events
) GROUP BY 1, 2
"""


def _upserted(spark: SparkSession, sf: str, partition: str | None) -> DataFrame:
    """Everything but clicks first, then the clicks and, again, the latest others."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.when(F.col("event_type") == "click", F.col("value") * 10).otherwise(F.col("value")).alias("value"), "event_type")
    path, keys = scratch_path(spark, "upsert"), ["user_id", "day"]
    I.key_upsert(e.where("event_type <> 'click'").drop("event_type"), path, keys, ["event_id"], partition)
    latest = I.keep_last(e, keys, ["event_id"])
    I.key_upsert(latest.where("event_type = 'click'").drop("event_type"), path, keys, ["event_id"], partition)
    return R.read_files(spark, path).select("user_id", "day", "event_id", "value")


@query("key_upsert", _UPSERT)
def key_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf, "day")


@query("key_upsert_unpartitioned", _UPSERT)
def key_upsert_unpartitioned(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf, None)


@query("strategies", """
SELECT s AS strategy, event_id, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value FROM events, (VALUES ('full_refresh'), ('partition_replace'), ('key_upsert'), ('entity_state_update')) t(s)
""")
def strategies(spark: SparkSession, sf: str) -> DataFrame:
    """The same change by each of the four strategies."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    new = e.withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1).otherwise(F.col("value")))
    out = None
    for name in ("full_refresh", "partition_replace", "key_upsert", "entity_state_update"):
        path = scratch_path(spark, name)
        W.write_partitioned(e, path, by="event_type") if name != "full_refresh" else W.write_output(e, path)
        change = new if name == "full_refresh" else new.where("event_type = 'click'")
        I.materialise(change, name, path, partition="event_type", keys=["event_id"], order_by=["event_id"])
        part = R.read_files(spark, path).select(F.lit(name).alias("strategy"), "event_id", "value")
        out = part if out is None else out.union(part)
    return out


@query("incremental_refresh", "SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events")
def incremental_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the first 20 days, then only the users with later events anew; equals a full computation."""
    e, path = table(spark, sf, "events"), scratch_path(spark, "features")
    h = History("user_id", "ts", ["event_id"])
    build = lambda df: h.build(df, [[{"type": "count", "name": "seen"}]]).select("event_id", "user_id", "seen")
    old, new = e.where("ts < timestamp'2024-01-21'"), e.where("ts >= timestamp'2024-01-21'")
    build(old).write.parquet(path)
    affected = new.select("user_id").distinct()
    I.key_upsert(build(e.join(affected, "user_id", "left_semi")), path, ["event_id"], ["seen"])
    return R.read_files(spark, path)


@query("intake_twice", """
SELECT CAST(user_id AS VARCHAR) AS u, COUNT(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE event_type || (event_id % 3 = 0) END) AS changes, 0 AS again FROM events GROUP BY 1
""")
def intake_twice(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of which some came before, taken twice: each change is there once, and the second time none is new."""
    path, changes = scratch_path(spark, "intake"), _changes(spark, sf)
    first = take_changes(changes.where("event_id % 5 < 3"), path)
    rest, again = take_changes(changes, path), take_changes(changes, path)
    by_user = lambda df, name: df.groupBy(F.col("entity_keys")["user_id"].alias("u")).agg(F.count(F.lit(1)).alias(name))
    taken = by_user(first.select("entity_keys").union(rest.select("entity_keys")), "changes")
    late = by_user(again, "again").withColumnRenamed("u", "v")
    return taken.join(late, F.col("u") == F.col("v"), "left").select("u", "changes", F.coalesce("again", F.lit(0)).cast("int").alias("again"))


@query("aggregate_refresh", """
SELECT user_id, event_type, COUNT(*) AS n, COUNT(value) AS filled, round(SUM(value), 4) AS total, round(AVG(value), 6) AS mean, MIN(value) AS low, MAX(value) AS high
FROM events WHERE NOT (day(ts) < 15 AND event_id % 7 = 0 OR event_type = 'error' AND user_id % 5 = 0) GROUP BY 1, 2
""")
def aggregate_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates of the first two weeks, then what came later added and what was deleted subtracted; equals a full build."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    gone = F.expr("day(ts) < 15 and event_id % 7 = 0 or event_type = 'error' and user_id % 5 = 0")
    kinds = {"filled": ("count", "value"), "total": ("sum", "value"), "mean": ("avg", "value"), "low": ("min", "value"), "high": ("max", "value")}
    view = AggregateView(spark, scratch_path(spark, "aggregates"), ["user_id", "event_type"], kinds, buckets=8)
    early = F.dayofmonth("ts") < 15
    view.rebuild(e.where(early))
    view.refresh(e.where(~early & ~gone), e.where(early & gone), e.where(~gone))
    return view.read().withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Changes read back from manifests of at most about 50 changes each, built by user."""
    e = table(spark, sf, "events")
    m = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    changes = e.select(
        F.col("user_id").alias("user"), F.lit("feed").alias("source"), F.lit("upsert").alias("change_type"), F.lit("key").alias("grain"), m("event_id", F.col("event_id")).alias("primary_key"),
        m("partition_date", F.date_format("ts", "yyyy-MM-dd")).alias("partition_keys"), m("user_id", F.col("user_id")).alias("entity_keys"),
    )
    return I.build_manifests(changes, {"pipeline": "events", "source": "feed", "mode": "incremental"}, ["user"], most=50)


@query("manifest_build", "SELECT CAST(user_id AS VARCHAR) AS user, COUNT(*) AS record_count, COUNT(*) AS changes, COUNT(DISTINCT event_id) AS events FROM events GROUP BY 1")
def manifest_build(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that manifests state, and those of the changes read back from them."""
    built = stored(_manifests(spark, sf), "manifests")
    stated = built.groupBy(F.col("user").cast("string").alias("user")).agg(F.sum("record_count").alias("record_count"))
    back = I.manifest_changes(built).groupBy(F.split("run_id", "-")[0].alias("u")).agg(F.count(F.lit(1)).alias("changes"), F.count_distinct(F.col("primary_key")["event_id"]).alias("events"))
    return stated.join(back, F.col("user") == F.col("u")).drop("u")


@query("manifest_partitions", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS partition_date FROM events")
def manifest_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return I.manifest_values(I.manifest_changes(_manifests(spark, sf)), "partition_date")


@query("manifest_summary", "SELECT CAST(user_id AS VARCHAR) AS run_id, COUNT(*) AS changes, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def manifest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return I.manifest_changes(_manifests(spark, sf)).withColumn("run_id", F.split("run_id", "-")[0]).groupBy("run_id").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct(F.col("partition_keys")["partition_date"]).alias("days"))


# Entity state ---------------------------------------------------------------------------

_STATE = "COUNT(*) OVER w AS n, round(SUM(value) OVER w, 4) AS total, value AS \"last\", MIN(value) OVER w AS low, MAX(value) OVER w AS high"
_STATE_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def _states(df: DataFrame, start: DataFrame | None = None) -> DataFrame:
    return I.fold_states(df, "user_id", ["ts", "event_id"], "value", start)


@query("entity_state_fold", f"SELECT event_id, {_STATE} FROM events {_STATE_W}")
def entity_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _states(table(spark, sf, "events")).select("event_id", "n", F.round("total", 4).alias("total"), "last", "low", "high")


@query("entity_latest_state", "SELECT user_id, COUNT(*) AS n, round(SUM(value), 4) AS total, arg_max(value, (ts, event_id)) AS \"last\" FROM events GROUP BY 1")
def entity_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    out = I.latest_state(_states(table(spark, sf, "events")), "user_id", ["ts", "event_id"], ["n", "total", "last"])
    return out.withColumn("total", F.round("total", 4))


@query("state_replay_equiv", f"SELECT event_id, n, total, low, high FROM (SELECT event_id, ts, {_STATE} FROM events {_STATE_W}) WHERE ts >= TIMESTAMP '2024-01-15'")
def state_replay_equiv(spark: SparkSession, sf: str) -> DataFrame:
    """Replaying the events after a checkpoint from the checkpoint equals the full fold."""
    e = table(spark, sf, "events")
    before = _states(e.where("ts < timestamp'2024-01-15'"))
    checkpoint = stored(I.latest_state(before, "user_id", ["ts", "event_id"], ["n", "total", "last", "low", "high"]), "checkpoint")
    return _states(e.where("ts >= timestamp'2024-01-15'"), checkpoint).select("event_id", "n", F.round("total", 4).alias("total"), "low", "high")


@query("asof_checkpoint", """
SELECT e.event_id, c.checkpoint_id FROM events e LEFT JOIN (SELECT user_id, ts, event_id AS checkpoint_id FROM events WHERE event_type = 'signup') c
ON c.user_id = e.user_id AND c.ts <= e.ts QUALIFY ROW_NUMBER() OVER (PARTITION BY e.event_id ORDER BY c.ts DESC NULLS LAST) = 1
""")
def asof_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("checkpoint_id"))
    return I.asof(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "ts", ["checkpoint_id"]).select("event_id", "checkpoint_id")


# Streams ----------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, allowed: str | None = "6h") -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return S.file_stream(spark, sf, schema, "ts", allowed, pattern="events.parquet*")


_TUMBLE = "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')) AS us, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1, 2"


@query("stream_tumbling", _TUMBLE)
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = S.drained(S.windowed_counts(_stream(spark, sf, None), "ts", "1 hour", None, ["event_type"], "value"), "complete")
    return out.select(F.unix_micros("start").alias("us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", """
SELECT epoch_us(b + INTERVAL (k) HOUR) AS us, COUNT(*) AS n FROM (SELECT ts, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS b FROM events), (SELECT unnest([-2, -1, 0]) AS k) GROUP BY 1
""")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = S.drained(S.windowed_counts(_stream(spark, sf, None), "ts", "3 hours", "1 hour"), "complete")
    return out.select(F.unix_micros("start").alias("us"), "n")


@query("stream_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT user_id, ts, SUM(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(MIN(ts)) AS us, COUNT(*) AS n FROM h GROUP BY user_id, k
""")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    return S.drained(S.sessions(_stream(spark, sf, None), "ts", "2 hours", "user_id"), "complete").select("user_id", F.unix_micros("start").alias("us"), "n")


@query("stream_watermark", "WITH t AS (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS b, COUNT(*) AS n FROM events GROUP BY 1) SELECT epoch_us(b) AS us, n FROM t WHERE b + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 6 HOUR FROM events)")
def stream_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """Closed windows only: those that end before the watermark."""
    return S.drained(S.windowed_counts(_stream(spark, sf), "ts", "1 day"), "append").select(F.unix_micros("start").alias("us"), "n")


@query("stream_dedupe", "SELECT user_id, event_type, COUNT(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) FROM events) GROUP BY 1, 2")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first event of a type and day, counted from what the stream let through."""
    once = S.deduplicated(_stream(spark, sf, "60d").withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"])
    return S.drained(once, "append").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("late_events_batch", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1")
def late_events_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A feed whose third file is late rows: each batch builds the days that it touches anew."""
    path, feed, e = scratch_path(spark, "days"), scratch_path(spark, "feed"), table(spark, sf, "events")
    seen = e.withColumn("day", F.to_date("ts"))
    for i, cond in enumerate(("day(ts) < 10 and event_id % 5 <> 0", "day(ts) >= 10 and event_id % 5 <> 0", "event_id % 5 = 0")):
        e.where(cond).write.mode("append").parquet(f"{feed}/f{i}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(feed).withColumn("day", F.to_date("ts"))
    build = lambda days: seen.join(days, "day", "left_semi").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    S.stream_partitions(stream, build, path, "day")
    return R.read_files(spark, path).select("day", "n", "total")


@query("stream_upsert", _UPSERT.replace("value * 10", "value"))
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-upsert")
    rows = _stream(spark, sf, None).select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    S.stream_upsert(rows, path, ["user_id", "day"], ["event_id"], "day")
    return R.read_files(spark, path).select("user_id", "day", "event_id", "value")


def _feed(spark: SparkSession, rows: DataFrame, batch: Column, files: int | None = None) -> tuple[str, int]:
    """Writes rows to a folder as a feed of batches, one after another by their number; its path pattern, and the files of a batch, the same for all, which a trigger is to take together.

    Files are taken by their age, so a batch's files are all older than the next one's. Small batches are one file each.
    """
    feed, came = scratch_path(spark, "feed"), rows.withColumn("__batch", batch)
    sizes = dict(came.groupBy("__batch").agg(F.count(F.lit(1))).collect())  # a row a batch
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows are dealt in turn by each task, so one of them that has a row for every file leaves no file out.
    if not sizes or min(sizes.values()) < files * came.rdd.getNumPartitions():
        files = 1
    for i, n in enumerate(sorted(sizes)):
        own = came.where(F.col("__batch") == n).drop("__batch")
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.parquet(f"{feed}/f{i:06d}")
    if not sizes:
        rows.write.parquet(f"{feed}/f{0:06d}")
    return f"{feed}/*", files


def _event_feed(spark: SparkSession, sf: str, parts: int = 3) -> DataFrame:
    """A stream of events that come in several batches."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    feed, files = _feed(spark, e, F.pmod("event_id", F.lit(parts)))
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(feed).select("user_id", "ts", "value")


@query("stream_entity_state", "SELECT user_id, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1")
def stream_entity_state(spark: SparkSession, sf: str) -> DataFrame:
    """State that goes on over batches; the last of each user."""
    return S.drained(S.entity_states(_event_feed(spark, sf), "user_id", "ts", "value"), "update", ["user_id"]).withColumn("total", F.round("total", 4))


@query("stream_state_tables", """
WITH b AS (SELECT user_id, event_id % 3 AS b, value FROM events), s AS (SELECT DISTINCT user_id, b FROM b)
SELECT user_id, (SELECT COUNT(*) FROM events e WHERE e.user_id = s.user_id) AS latest_n, COUNT(*) AS history_rows, (SELECT COUNT(*) FROM events e WHERE e.user_id = s.user_id) AS checkpoint_n FROM s GROUP BY 1
""")
def stream_state_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Latest states, the history of each batch's changes, and the last checkpoint."""
    base = scratch_path(spark, "states")
    S.persist_states(S.entity_states(_event_feed(spark, sf), "user_id", "ts", "value"), base, "user_id", every=1)
    history = R.read_files(spark, f"{base}/history").groupBy("user_id").agg(F.count(F.lit(1)).alias("history_rows"))
    last = S.checkpoint(spark, base).select("user_id", F.col("n").alias("checkpoint_n"))
    return R.read_files(spark, f"{base}/latest").select("user_id", F.col("n").alias("latest_n")).join(history, "user_id").join(last, "user_id")


class _Clicks(S.StateProcessor):
    """The largest value and the number of values over 50, which don't depend on the order."""

    ordered = False
    schema = "top double, high bigint"

    def start(self) -> tuple:
        return (0.0, 0)

    def apply(self, state: tuple, events) -> tuple:  # noqa: ANN001
        return (max(state[0], float(events[self.value].max())), state[1] + int((events[self.value] > 50).sum()))

    def aggregates(self) -> list[Column]:
        value = S.number(self.value)
        return [F.greatest(F.lit(0.0), F.max(value)), F.count_if(value > 50)]


@query("stream_custom_state", "SELECT user_id, greatest(0, MAX(value)) AS top, COUNT(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1")
def stream_custom_state(spark: SparkSession, sf: str) -> DataFrame:
    """A processor of one's own."""
    return S.drained(S.entity_states(_event_feed(spark, sf), "user_id", "ts", "value", _Clicks("value")), "update", ["user_id"])


class _Rises(S.StateProcessor):
    """How often the value rose from an event to the next one, and the last value: a fold that depends on the order."""

    schema = "n bigint, rises bigint, last double"

    def start(self) -> tuple:
        return (0, 0, None)

    def apply(self, state: tuple, events) -> tuple:  # noqa: ANN001
        n, rises, last = state
        for v in events[self.value].tolist():
            n, rises, last = n + 1, rises + int(last is not None and v > last), v
        return (n, rises, last)


def _unsorted_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events in batches of some days, each up to four days late, with a watermark that waits for them."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value").where("ts is not null")
    feed, files = _feed(spark, e, F.floor((F.unix_date(F.to_date("ts")) + F.pmod("event_id", F.lit(5))) / 8))
    return S.file_stream(spark, feed, e.schema, "ts", "5d", files)


#: Spark's watermark counts whole milliseconds.
_RISES = """
WITH w AS (SELECT user_id, ts, event_id, value, value > LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rose FROM events WHERE ts <= (SELECT date_trunc('milliseconds', MAX(ts)) - INTERVAL 5 DAY FROM events))
SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE rose) AS rises, arg_max(value, (ts, event_id)) AS "last" FROM w GROUP BY 1
"""


@query("stream_ordered_state", _RISES)
def stream_ordered_state(spark: SparkSession, sf: str) -> DataFrame:
    """An order-dependent fold of events that come out of order: each waits for the watermark."""
    return S.drained(S.entity_states(_unsorted_feed(spark, sf), "user_id", "ts", "value", _Rises("value"), tiebreak=["event_id"]), "update", ["user_id"])
