"""Sources, sinks, tables, rollups, incremental refresh, streams and checks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemill.operators import checks as K
from tidemill.operators import experiments as EX
from tidemill.operators import incremental as I
from tidemill.operators import metrics as M
from tidemill.operators import ml
from tidemill.operators.rank import key_positions
from tidemill.operators.sqlmodels import date_params, model_sql, rendered, run_models
from tidemill.operators.steps import run_step
from tidemill.operators.tables import DatedTable, RollupError, rollup, rollup_tiers
from tidemill.plans import lifecycle
from tidemill.plans.registry import SQL
from tidemill.sources import readers as R
from tidemill.sources import writers as W
from tidemill.streaming import streams as S


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_partition_replace_leaves_others_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda *x: spark.createDataFrame(x, "id bigint, bucket string, value bigint")
    I.partition_replace(make((1, "A", 10), (2, "B", 20)), path, "bucket")
    assert rows(I.partition_replace(make((1, "A", 99), (3, "A", 30)), path, "bucket"), "bucket") == [("A", 2)]
    assert rows(R.read_files(spark, path).select("id", "bucket", "value"), "id") == [(1, "A", 99), (2, "B", 20), (3, "A", 30)]


def test_key_upsert(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ["day", "e"]
    make = lambda *x: spark.createDataFrame(x, "day string, e string, value bigint, seq int")
    I.key_upsert(make(("1", "e1", 10, 1), ("1", "e2", 20, 1), ("2", "e3", 30, 1)), path, keys, ["seq"], "day")
    new = make(("1", "e2", 0, 1), ("1", "e2", 200, 2), ("1", "e4", 40, 1))
    for _ in range(2):  # once more changes nothing
        assert rows(I.key_upsert(new, path, keys, ["seq"], "day"), "day") == [("1",)]
        got = R.read_files(spark, path).select("day", "e", "value")
        assert rows(got, "day", "e") == [("1", "e1", 10), ("1", "e2", 200), ("1", "e4", 40), ("2", "e3", 30)]


def test_key_upsert_of_a_moved_key(spark, tmp_path):
    for whole, left in ((False, 2), (True, 1)):
        path = f"{tmp_path}/t{whole}"
        make = lambda *x: spark.createDataFrame(x, "day string, e string, seq int")
        I.key_upsert(make(("a", "e1", 1)), path, ["e"], ["seq"], "day")
        I.key_upsert(make(("b", "e1", 2)), path, ["e"], ["seq"], "day", global_key=whole)
        assert R.read_files(spark, path).count() == left


def test_propagation(spark):
    m = "map<string,string>"
    events = I.change_events(spark.createDataFrame([("raw", {"partition_date": "2026-01-01", "group_id": "1"}, {"entity_id": "entity-1"})], f"source_name string, primary_key {m}, entity_keys {m}"))
    assert events.first().change_type == "upsert"
    start = I.affected_keys(events, "normalize", "key", ["partition_date", "group_id", "entity_id"])
    units = I.propagate(start, [
        {"from": "normalize", "to": "state", "mode": "entity", "key_mapping": {"entity_id": "entity_id"}}, {"from": "normalize", "to": "slice", "mode": "partition", "key_mapping": {"partition_date": "partition_date"}},
        {"from": "state", "to": "late", "mode": "key", "key_mapping": {"entity_id": "who"}},
    ])
    assert {(u.node, tuple(sorted(u["keys"].items()))) for u in units.collect()} == {
        ("normalize", (("entity_id", "entity-1"), ("group_id", "1"), ("partition_date", "2026-01-01"))), ("state", (("entity_id", "entity-1"),)),
        ("slice", (("partition_date", "2026-01-01"),)), ("late", (("who", "entity-1"),)),
    }
    with pytest.raises(ValueError):
        I.change_events(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(Exception, match="no source"):
        I.change_events(spark.createDataFrame([(None,)], "source string")).collect()
    loop = I.propagate(start, [{"from": "normalize", "to": "n2", "mode": "key", "key_mapping": {"entity_id": "x"}}, {"from": "n2", "to": "normalize", "mode": "key", "key_mapping": {"x": "entity_id"}}])
    found = [(u.node, u.key_json) for u in loop.collect()]
    assert len(found) == 3 and {("n2", '{"x":"entity-1"}'), ("normalize", '{"entity_id":"entity-1"}')} < set(found)


def test_manifests(spark):
    m = "map<string,string>"
    made = [("feed", "upsert", "key", {"id": str(i)}, {"day": f"2024-01-0{1 + i % 3}"}, {"who": "a" if i % 3 else "b"}, "a" if i % 3 else None) for i in range(30)]
    changes = spark.createDataFrame(made, f"source string, change_type string, grain string, primary_key {m}, partition_keys {m}, entity_keys {m}, who string")
    for by in ([], ["who"]):
        built = I.build_manifests(changes, {"pipeline": "p"}, by, most=7)
        assert built.agg(F.sum("record_count")).first()[0] == 30 and built.count() > 3
        back = I.manifest_changes(built)
        assert sorted(int(r.primary_key["id"]) for r in back.collect()) == list(range(30)) and back.first().pipeline == "p"
    assert sorted(r[0] for r in I.manifest_values(back, "day").collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"]


@pytest.mark.parametrize("prefer, key", [("daily", "data_2026_03_14.parquet"), ("monthly", "data_2026_03.parquet"), ("yearly", "data_2026.parquet")])
def test_slice_resolution(spark, prefer, key):
    files = R.with_tier(spark.createDataFrame([("t", k) for k in ("data_2026.parquet", "data_2026_03.parquet", "data_2026_03_14.parquet", "readme.txt")], "table string, key string"))
    dates = spark.createDataFrame([(dt.date(2026, 3, 14),), (dt.date(2025, 1, 1),)], "date date")
    assert [r.key for r in R.resolve_slices(files, dates, prefer).collect()] == [key]
    assert rows(files.where("key like '%_03.%'").select("tier", "start_date", "end_date"), "tier") == [("monthly", dt.date(2026, 3, 1), dt.date(2026, 3, 31))]


def test_slices_of_nested_paths_and_odd_spans(spark, tmp_path):
    """A key that ends another one's path, files of other spans, and dates asked of one table."""
    day = lambda d: dt.date(2026, 3, d)
    for key, n in (("a.parquet", 1), ("b/a.parquet", 2)):
        spark.createDataFrame([(day(1), n), (day(2), n)], "d date, n int").coalesce(1).write.parquet(f"{tmp_path}/{key}")
    chosen = spark.createDataFrame([("a.parquet", day(1)), ("b/a.parquet", day(2))], "key string, date date")
    assert rows(R.read_slices(spark, str(tmp_path), chosen, "d"), "d") == [(day(1), 1), (day(2), 2)]
    assert rows(R.read_slices(spark, f"file://{tmp_path}", chosen, "d"), "d") == [(day(1), 1), (day(2), 2)]
    files = [("t", "week", "weekly", day(2), day(8)), ("t", "month", "monthly", day(1), day(31)), ("t", "late", "monthly", day(20), dt.date(2026, 4, 10)), ("u", "day", "daily", day(3), day(3)), ("u", "never", "daily", day(9), day(8))]
    catalogue = spark.createDataFrame(files, "table string, key string, tier string, start_date date, end_date date")
    ask = [(day(d),) for d in (1, 3, 9, 25)] + [(dt.date(2026, 4, 5),)]
    got = {(r.table, r.date): r.key for r in R.resolve_slices(catalogue, spark.createDataFrame(ask, "date date"), "monthly").collect()}
    assert got == {("t", day(1)): "month", ("t", day(3)): "month", ("t", day(9)): "month", ("t", day(25)): "late", ("t", dt.date(2026, 4, 5)): "late", ("u", day(3)): "day"}
    one = R.resolve_slices(catalogue, spark.createDataFrame([("u", day(3)), ("t", day(3))], "table string, date date"), "daily")
    assert {(r.table, r.key) for r in one.collect()} == {("t", "month"), ("u", "day")} and one.columns == ["date", *catalogue.columns]


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        R.register(spark, {"a": {"path": "nowhere.parquet"}}, str(tmp_path))
    R.register(spark, {"a": {"path": "nowhere.parquet", "required": False, "empty_schema": {"x": "int"}}}, str(tmp_path))
    assert spark.table("a").schema.simpleString() == "struct<x:int>" and spark.table("a").count() == 0
    spark.range(1).write.parquet(f"{tmp_path}/serving")
    spark.range(2).write.parquet(f"{tmp_path}/raw")
    t = {"storage": {"local": f"{tmp_path}/raw"}, "profiles": {"serving_entity": {"local": f"{tmp_path}/serving"}}}
    assert R.profile_path(spark, t, "features").endswith("serving") and R.profile_path(spark, t, "backfill").endswith("raw")
    with pytest.raises(ValueError):
        W.write_partitioned(spark.range(1), f"{tmp_path}/x", expression="id % 2")


def _days(spark, base, month, days, tier="daily"):
    for d in days:
        spark.range(1).withColumn("d", F.lit(d)).coalesce(1).write.parquet(f"{base}/{tier}/data_2025_{month:02d}_{d:02d}")


def test_rollup_completeness(spark, tmp_path):
    base = str(tmp_path)
    _days(spark, base, 2, range(1, 28))
    with pytest.raises(RollupError, match="expected 28, got 27"):
        rollup_tiers(spark, base, "{tier}/data_{period}", [2025], {2025: [2]}, strict=True)
    assert not os.path.exists(f"{base}/monthly")
    _days(spark, base, 2, [28])
    with pytest.raises(RollupError, match="expected 12, got 1"):
        rollup_tiers(spark, base, "{tier}/data_{period}", [2025], {2025: [2]}, strict=True)
    assert spark.read.parquet(f"{base}/monthly/data_2025_02").count() == 28


def test_rollup_errors_and_gzip(spark, tmp_path):
    with pytest.raises(RollupError):
        rollup(spark, f"{tmp_path}/none", f"{tmp_path}/out")
    os.makedirs(f"{tmp_path}/bad")
    with open(f"{tmp_path}/bad/a.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(RollupError):
        rollup(spark, f"{tmp_path}/bad", f"{tmp_path}/out")
    import gzip

    for i in range(3):
        os.makedirs(f"{tmp_path}/in/{i:02d}")
        with gzip.open(f"{tmp_path}/in/{i:02d}/r.jsonl.gz", "wt") as f:
            f.write('{"id": "a%d", "price": "NaN"}\n\n{"id": "b%d", "price": "%d.5"}\n{"id": "c", "price": "2"}\n' % (i, i, i))
    assert rollup(spark, f"{tmp_path}/in", f"{tmp_path}/out", "jsonl", pattern="*.gz")["files"] == 3
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 9 and dict(out.dtypes)["price"] == "double" and out.where("price is null").count() == 3


def test_tables(spark, tmp_path):
    t = DatedTable(spark, "sales", f"{tmp_path}/sales", {"columns": [{"name": "n", "type": "INTEGER"}]})
    make = lambda *x: spark.createDataFrame([(str(v),) for v in x], "n string")
    for day, vs in (("2024-01-01", [1, 2]), ("2024-01-02", [3]), ("2024-02-01", [4]), ("2024-01-02", [5, 6])):
        t.ingest(make(*vs), day)
    with pytest.raises(Exception):  # noqa: B017
        t.ingest(spark.range(1), "2024-03-01")
    assert t.compact("2024-01") == 4
    assert t.read().count() == 5 and t.query("SELECT SUM(n) FROM sales").first()[0] == 18
    s = t.status().first()
    assert (s.days, s.rows, s.compactions, s.first_day, s.last_day) == (3, 5, 1, "2024-01-01", "2024-02-01")
    t.compact("2024-01", delete=True)
    assert t.read().count() == 5
    with pytest.raises(RollupError):
        t.compact("2030-01")


def test_late_days_and_repeated_compaction(spark, tmp_path):
    """A late day, a day ingested anew, an emptied day and a compaction after the daily files went."""
    for layout in ("yyyy-MM-dd", "yyyyMMdd"):
        t = DatedTable(spark, "t", f"{tmp_path}/{layout}", date_format=layout)
        make = lambda *x: spark.createDataFrame([(v,) for v in x], "n int")
        got = lambda: sorted((str(r["dt"])[-2:], r["n"]) for r in t.read().collect())  # noqa: E731, B023
        t.ingest(make(1), "2024-01-01")
        t.ingest(make(2), "2024-01-02")
        assert t.compact("2024-01") == 2
        t.ingest(make(3), "2024-01-03")
        t.ingest(make(20), "2024-01-02")
        assert got() == [("01", 1), ("02", 20), ("03", 3)]
        assert t.compact("2024-01", delete=True) == 3 and got() == [("01", 1), ("02", 20), ("03", 3)]
        assert not [d for d in os.listdir(t.daily) if d.startswith("dt=")]
        t.ingest(make(4), "2024-01-04")
        assert t.compact("2024-01", delete=True) == 4 and got() == [("01", 1), ("02", 20), ("03", 3), ("04", 4)]
        t.ingest(make(), "2024-01-03")
        assert got() == [("01", 1), ("02", 20), ("04", 4)]
        assert t.compact("2024-01") == 3 and t.compact("2024-01") == 3 and got() == [("01", 1), ("02", 20), ("04", 4)]


def test_steps():
    with pytest.raises(ValueError, match="lacks need"):
        run_step(lambda need: need, {"other": 1})
    with pytest.raises(TypeError):
        run_step(lambda x=1: x, {})


def test_datasets_by_name_or_path(spark, tmp_path):
    df = spark.range(3)
    df.createOrReplaceTempView("ds_view")
    df.write.parquet(f"{tmp_path}/part.parquet")
    df.write.option("header", True).csv(f"{tmp_path}/c.csv")
    assert [R.load_dataset(spark, n, str(tmp_path)).count() for n in ("ds_view", f"{tmp_path}/part.parquet", "part", "c.csv")] == [3] * 4
    with pytest.raises(FileNotFoundError):
        R.load_dataset(spark, "nowhere", str(tmp_path))
    assert rows(R.relations(spark, "ds_*"), "name") == [("ds_view", True)]
    assert [r.id for r in R.preview(df, 2, ["id"]).collect()] == [0, 1]


def test_ranks_with_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = key_positions(df, ["k"], partitions=2000)
    assert got.where("before <> k or place <> k or total <> 5000").count() == 0 and got.count() == 5000


def test_experiment(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7), 2.0 * i + i % 7, float(i > 50), i % 9) for i in range(100)], "a double, b double, y double, k double, g int")
    configs = {"good": {"model": "ridge", "features": ["a", "b"], "target": "y", "params": {"alpha": 0.01}}, "poor": {"model": "ridge", "features": ["b"], "target": "y"}, "broken": {"model": "ridge", "features": ["zz"], "target": "y"}}
    EX.run_experiment(df, df, configs, str(tmp_path), "e")
    runs, metrics = spark.read.parquet(f"{tmp_path}/runs"), spark.read.parquet(f"{tmp_path}/metrics")
    listing = {r.name: r for r in EX.run_listing(runs, metrics).collect()}
    assert {n: r.status for n, r in listing.items()} == {"good": "success", "poor": "success", "broken": "failed"} and "zz" in listing["broken"].error
    assert set(listing["good"].metrics) == {"test_score", "rmse", "mae"} and listing["broken"].metrics is None
    assert EX.best_run(runs, metrics, "test_score").first().name == "good" and EX.best_run(runs, metrics, "rmse", higher=False).first().name == "good"
    c = {"model": "logistic_regression", "features": ["a", "b"], "target": "k"}
    shares = EX.group_scores(ml.train(df, c), df, c, "g", ["a"])
    assert all(abs(r[1] - 1) < 1e-9 for r in shares.groupBy("g").agg(F.sum("share")).collect()) and shares.count() == 100


def test_models_and_checks(spark, tmp_path):
    spark.createDataFrame([(1, 5, "x"), (2, 7, None)], "id int, value int, name string").write.parquet(f"{tmp_path}/a")
    config = {
        "sources": {"src": {"path": "a"}}, "models": [{"name": "m1", "sql": "SELECT * FROM src WHERE value > {{ low }}", "materialized": "table"}, {"name": "m2", "sql": "SELECT COUNT(*) AS n FROM m1", "output": {"path": f"{tmp_path}/out"}}],
        "validations": [{"name": "names", "type": "failing_rows", "sql": "SELECT * FROM m1 WHERE name IS NULL", "severity": "warn"}, {"name": "rows", "type": "metric", "sql": "SELECT n FROM m2", "operator": "gte", "threshold": 3}],
    }
    with pytest.raises(K.ValidationError, match="rows"):
        run_models(spark, config, {"low": 1}, str(tmp_path))
    assert not os.path.exists(f"{tmp_path}/out")
    config["validations"].pop()
    assert run_models(spark, config, {"low": 6}, str(tmp_path))["m2"].first().n == 1 and os.path.exists(f"{tmp_path}/out")
    assert rendered("{{ a }} {{ b }}", {"a": 1}) == "1 {{ b }}" and date_params({"date": "2024-01-02"})["date_compact"] == "20240102"
    for bad in ({"name": "m"}, {"name": "m", "sql": "x", "sql_file": "y"}):
        with pytest.raises(ValueError):
            model_sql(bad)
    with pytest.raises(K.ValidationError):
        K.run_checks(spark, [{"name": "null", "type": "metric", "sql": "SELECT CAST(NULL AS INT)", "operator": "eq", "threshold": 1}])
    with pytest.raises(K.ValidationError):
        K.require_columns(spark.range(1), ["id", "gone"])


def test_models_refuse_leaks(spark):
    df = spark.range(3).withColumns({"x": F.col("id"), "y": F.col("id")})
    with pytest.raises(ml.LeakageError):
        ml.check_features(df, {"features": ["x"], "target": "y", "leakage_columns": ["x"]})
    with pytest.raises(ml.LeakageError):
        ml.check_features(df, {"features": ["x"], "target": "y", "binary_target": "id"})
    with pytest.raises(ValueError, match="missing"):
        ml.check_features(df, {"features": ["z"], "target": "y"})


def test_models_learn(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("c"))
    df = df.withColumns({"y": F.col("a") * 3 + F.col("b"), "k": (F.col("a") > 9).cast("int")})
    for model, target in (("ridge", "y"), ("gradient_boosting_regressor", "y"), ("random_forest_regressor", "y")):
        c = {"model": model, "features": ["a", "b", "c"], "target": target, "params": {"alpha": 0.01}}
        out = ml.predictions(ml.train(df, c), df, c, ["a"])
        assert M.regression(out, "y_actual", "y_pred").first().r2 > 0.85
    for model in ("logistic_regression", "random_forest_classifier", "gradient_boosting_classifier"):
        c = {"model": model, "features": ["a", "b", "c"], "target": "k"}
        m = ml.train(df, c)
        out = ml.predictions(m, df, c, [])
        assert M.classification(out, "k_actual", "k_pred").first().accuracy > 0.95 and M.auc(out, "k_actual", "k_pred_proba").first().auc > 0.95
        scored = ml.score(m, df, c, ["a"], ["low", "high one"], {"day": 1})
        assert scored.columns == ["a", "prediction", "prob_low", "prob_high_one", "probabilities_json", "model", "inference_run_at", "param_day"]
        assert ml.importance(m, c, df).orderBy(F.desc("importance")).first().feature == "a"
    assert ml.cross_validated(df, c, 2) > 0.9


def test_streams(spark, tmp_path):
    assert S.lateness("6h") == "6 hours"
    with pytest.raises(ValueError):
        S.lateness("soon")
    t0 = dt.datetime(2024, 1, 1)
    day = lambda d, i: (i, t0 + dt.timedelta(days=d), 1.0)
    for n, batch in enumerate(([day(0, 1), day(1, 2)], [day(9, 3)], [day(10, 4)], [day(0, 5), day(11, 6)], [day(12, 6)])):
        spark.createDataFrame(batch, "id bigint, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    stream = lambda allowed: S.file_stream(spark, f"{tmp_path}/in/*", "id bigint, ts timestamp, value double", "ts", allowed, 1)
    out = S.drained(S.windowed_counts(stream("6h"), "ts", "1 day"))
    assert rows(out.select(F.dayofmonth("start"), "n"), "start")[:2] == [(1, 1), (2, 1)]  # the late row of day 1 was dropped
    assert S.drained(S.deduplicated(stream("30d"), ["id"])).count() == 6
    states = S.drained(S.entity_states(stream(None), "id", "ts", "value"), "update", ["id"])
    assert rows(states, "id") == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0), (5, 1, 1.0), (6, 2, 2.0)]
    with pytest.raises(ValueError):
        S.drained(S.entity_states(stream(None), "id", "ts", "value"), "update")
    base = f"{tmp_path}/states"
    S.persist_states(S.entity_states(stream(None), "id", "ts", "value"), base, "id", every=2)
    latest = R.read_files(spark, f"{base}/latest")
    assert rows(latest, "id") == rows(states, "id")
    history = spark.read.parquet(f"{base}/history")
    assert history.count() == 7 and rows(history.where("id = 6").select("n"), "n") == [(1,), (2,)]
    assert S.checkpoints(spark, base) == [1, 3] and rows(S.checkpoint(spark, base, 1), "id") == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    os.makedirs(f"{tmp_path}/none")
    nothing = S.file_stream(spark, f"{tmp_path}/none", "id bigint, ts timestamp, value double", "ts")
    assert S.drained(S.entity_states(nothing, "id", "ts", "value"), "update", ["id"]).count() == 0 and S.drained(nothing).count() == 0


def test_fold_from_checkpoint_and_asof(spark):
    e = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5])] + [(2, 9, 2.0)], "u int, t int, v double")
    full = {(r.u, r.t): (r.n, r.total, r.low, r.high) for r in I.fold_states(e, "u", ["t"], "v").collect()}
    mark = I.latest_state(I.fold_states(e.where("t < 3"), "u", ["t"], "v"), "u", ["t"], ["n", "total", "last", "low", "high"])
    for r in I.fold_states(e.where("t >= 3"), "u", ["t"], "v", mark).collect():
        assert (r.n, r.total, r.low, r.high) == full[(r.u, r.t)]
    left = spark.createDataFrame([(1, 0), (1, 5), (2, 1), (3, 1)], "u int, at int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 2, "c")], "u int, t int, x string")
    assert rows(I.asof(left, right, "u", "at", "t", ["x"]), "u", "at") == [(1, 0, None), (1, 5, "b"), (2, 1, None), (3, 1, None)]


def test_a_batch_of_a_feed_is_one_trigger_however_many_files_it_has(spark, tmp_path):
    """Events that come out of order from a table of several files: none is dropped as late."""
    duckdb = pytest.importorskip("duckdb")
    events = spark.range(3000).selectExpr("id as event_id", "timestamp_millis(1704067200000 + id * 800000) as ts", "id % 7 as user_id", "cast(hash(id) % 100 as double) as value")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in lifecycle.stream_ordered_state(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.sql(SQL["stream_ordered_state"]).fetchall())


@pytest.mark.parametrize("kind", [S.Totals, lifecycle._Clicks])
def test_states_by_aggregates_equal_folds(spark, tmp_path, kind):
    """Spark holds the state of a processor that states its aggregates, without Python; it is what apply folds."""
    values = spark.range(400).selectExpr("if(id % 11 = 0, null, id % 9) as id", "timestamp_seconds(id) as ts", "if(id % 13 = 0, null, if(id % 17 = 0, double('NaN'), cast(id % 101 as double))) as value")
    for i in range(2):
        values.where(f"hour(ts) = 0 and second(ts) % 2 = {i}").coalesce(1).write.parquet(f"{tmp_path}/f/{i}")
    stream = lambda: spark.readStream.schema(values.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f/*")
    fold = type("Fold", (kind,), {"aggregates": lambda self: None})
    made = [S.entity_states(stream(), "id", "ts", "value", k("value")) for k in (kind, fold)]
    assert "FlatMapGroupsInPandas" not in made[0]._jdf.queryExecution().analyzed().toString() and made[0].schema.simpleString() == made[1].schema.simpleString()
    assert rows(S.drained(made[0], "update", ["id"]), "id") == rows(S.drained(made[1], "update", ["id"]), "id")
