"""Expressions, filters, datasets, features, history and ranks on small frames."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import exprs as X
from tidemill.operators import features as FE
from tidemill.operators.dataset import build_dataset, merge_sources
from tidemill.operators.history import History
from tidemill.operators.rank import global_rank


def test_safe_casts_round_as_they_should(spark):
    df = spark.createDataFrame([("3.7", 2.5), ("-3.5", 3.5), ("x", None), (" 12 ", -2.5), (None, 1e300)], "t string, d double")
    got = df.select(X.safe_cast(df, F.col("t"), "INTEGER").alias("t"), X.safe_cast(df, F.col("d"), "INT").alias("d"), X.safe_cast(df, F.col("t"), "INT", 7).alias("e")).collect()
    assert [tuple(r) for r in got] == [(4, 2, 4), (-4, 4, -4), (None, None, 7), (12, -2, 12), (None, None, 7)]
    assert X.type_of(df, X.safe_cast(df, F.col("d"), "DECIMAL")).simpleString() == "decimal(18,3)"
    assert X.type_of(df, X.safe_cast(df, F.col("d"), "DECIMAL", 1)).simpleString() == "double"


def test_unknown_operators_are_errors():
    for bad in ({"column": "a", "operator": "almost"},):
        with pytest.raises(ValueError):
            X.predicate(bad)
    with pytest.raises(ValueError):
        X.quality_condition({"type": "nice", "column": "a"})


def test_parameters(spark):
    df = spark.createDataFrame([(1, "a'b"), (2, None), (3, "c\\d")], "id int, t string")
    ids = lambda f, p, w=None, r=(): [x.id for x in df.where(X.param_filters(f, p, w, r)[0]).orderBy("id").collect()]
    text = [{"column": "t"}]
    assert ids(text, {"t": "a'b"}) == [1] and ids(text, {"t": "c\\d"}) == [3] and ids(text, {"t": None}) == [2]
    assert ids(text, {}) == [1, 2, 3] and ids([{"column": "t", "include_if_missing": True}], {}) == [2]
    assert ids([], {"x": "a'b"}, "t = {x}") == [1] and ids([], {"x": "c\\d"}, "t = {x}") == [3]
    assert ids([{"column": "id", "operator": "NOT IN", "type": "int", "aliases": ["ids"], "param": "none"}], {"ids": ["1", 2]}) == [3]
    assert ids([{"column": "id", "type": "int", "default": "3"}], {}) == [3]
    with pytest.raises(ValueError):
        ids([{"column": "t", "required": True}], {})
    with pytest.raises(ValueError):
        ids([], {}, None, ["day"])


def test_nan_texts_and_numeric_columns(spark):
    df = spark.createDataFrame([("1.5", "a"), ("NaN", "1"), ("2.3", "b")], "price string, other string")
    out = X.auto_numeric(X.null_markers(df))
    assert dict(out.dtypes) == {"price": "double", "other": "string"}
    assert [r.price for r in out.collect()] == [1.5, None, 2.3]


def test_joins_need_conditions(spark):
    a, b = spark.range(2).withColumnRenamed("id", "x"), spark.range(3).withColumnRenamed("id", "y")
    config = {"sources": [{"name": "a"}, {"name": "b"}], "columns": [{"name": "x", "source": "a"}, {"name": "y", "source": "b"}]}
    with pytest.raises(ValueError):
        merge_sources({"a": a, "b": b}, config)
    assert merge_sources({"a": a, "b": b}, config | {"join": {"type": "cross"}}).count() == 6


def test_filters_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("unused")).write.parquet(path)
    df = build_dataset(spark.read.parquet(path), {"columns": [{"name": "id"}], "filters": [{"column": "k", "operator": "=", "value": 3}]})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "unused" not in plan


def test_windows_without_partitions_are_refused():
    with pytest.raises(ValueError):
        FE.window_feature({"name": "r", "function": "rank", "order_by": ["a"]})
    with pytest.raises(ValueError):
        FE.window_feature({"name": "r", "function": "rank", "partition_by": ["a"]})


def _events(spark, rows):
    return spark.createDataFrame([(i, u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(v)) for i, (u, h, v) in enumerate(rows)], "event_id bigint, user_id int, ts timestamp, value double")


def test_history_never_looks_ahead(spark):
    r = random.Random(3)
    df = _events(spark, [(r.randint(0, 4), r.randint(0, 40), r.randint(0, 9)) for _ in range(200)])
    h = History("user_id", "ts", ["event_id"])
    features = [
        {"type": "count", "name": "n"}, {"type": "average", "name": "m", "expression": "value", "windows": ["all_time", "last_3"]}, {"type": "time_since_last_event", "name": "gap"},
        {"type": "count", "name": "big", "filter": "value > 5"}, {"type": "diff_from_last", "name": "d", "expression": "value"},
    ]
    full = h.build(df, [features])
    cut = "ts < timestamp'2024-01-02 00:00:00'"
    assert sorted(map(tuple, full.where(cut).collect()), key=str) == sorted(map(tuple, h.build(df.where(cut), [features]).collect()), key=str)
    rows = sorted(df.collect(), key=lambda x: (x.ts, x.event_id))
    for x in full.collect():
        before = [y.value for y in rows if y.user_id == x.user_id and (y.ts, y.event_id) < (x.ts, x.event_id)]
        assert x.n == len(before) and x.big == sum(v > 5 for v in before)
        last = before[-3:]
        assert x.m_last_3 == (pytest.approx(sum(last) / len(last)) if last else None)


def test_look_back_features_of_an_entity_share_one_shuffle(spark):
    h = History("user_id", "ts", ["event_id"])
    df = h.build(_events(spark, [(1, 1, 1)]), [[{"type": "count", "name": "n"}, {"type": "average", "name": "m", "expression": "value", "windows": ["last_3", "last_5"]}, {"type": "time_since_last_event", "name": "g"}]])
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=30))
def test_global_rank(spark, values):
    got = global_rank(spark.createDataFrame(list(enumerate(values)), "id int, v int"), ["v DESC"]).collect()
    key = lambda v: (v is None, -(v or 0))
    assert len(got) == len(values)
    for r in got:
        assert r["rank"] == 1 + sum(key(v) < key(r.v) for v in values)
        assert r.dense_rank == 1 + len({key(v) for v in values if key(v) < key(r.v)})
        assert r.cume_dist == pytest.approx(sum(key(v) <= key(r.v) for v in values) / len(values))
