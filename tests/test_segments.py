"""Hot keys: the same results by time ranges as by whole keys, with no range near a key's size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import incremental as I
from tidemill.operators import segments
from tidemill.operators.history import History


@pytest.fixture(scope="module")
def events(spark):
    """Half of all rows in one entity; equal times, null times, null values."""
    r = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        u = 1 if i % 2 else r.choice([2, 3, 4, 5, None])
        rows.append((u, None if i % 97 == 0 else t0 + dt.timedelta(minutes=r.randrange(4000)), i, r.choice(["a", "b", "c"]), None if i % 11 == 0 else round(r.uniform(-50, 50), 2)))
    return spark.createDataFrame(rows, "u bigint, ts timestamp, id bigint, kind string, value double").cache()


def near(got, want, by="id"):
    a, b = ({r[by]: r.asDict() for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) > 0
    for k, row in b.items():
        assert a[k].keys() == row.keys()
        for c, v in row.items():
            assert a[k][c] == (pytest.approx(v, abs=1e-6) if isinstance(v, float) else v), (k, c)


def test_ranges(spark, events):
    cuts = segments.hot_cuts(events, "u", "ts", 200)
    cold, hot = segments.parted(events, "u", "ts", cuts)
    assert cold.count() + hot.count() == 3000 and cold.where("u = 1").count() == 0
    sizes = [r["count"] for r in hot.groupBy("u", segments.SEG).count().collect()]
    assert max(sizes) < 400 and len(sizes) >= 8
    split = hot.groupBy("u", "ts").agg(F.count_distinct(segments.SEG).alias("n")).where("n > 1").count()
    assert split == 0 and segments.hot_cuts(events, "u", "ts", 10_000) is None


FEATURES = [
    {"type": "count", "name": "seen"}, {"type": "sum", "name": "s", "expression": "value"}, {"type": "average", "name": "m", "expression": "value", "windows": ["all_time", "last_3", "last_70"]},
    {"type": "stddev", "name": "sd", "expression": "value", "windows": ["all_time", "last_5"]}, {"type": "min", "name": "lo", "expression": "value"}, {"type": "max", "name": "hi", "expression": "value", "filter": "kind = 'a'"},
    {"type": "count", "name": "same", "partition_by": ["kind"], "windows": ["all_time", "last_4"]}, {"type": "time_since_last_event", "name": "gap"}, {"type": "is_first_time", "name": "new", "context": ["kind"]},
    {"type": "diff_from_last", "name": "d", "expression": "value", "partition_by": ["kind"]}, {"type": "contextual_delta_from_min", "name": "c", "expression": "value", "context": ["kind"], "lagged": True}, {"type": "derived", "name": "x", "expression": "s + seen"},
]


@pytest.mark.parametrize("rows", [150, 40])
def test_history_by_ranges(events, rows):
    build = lambda n: History("u", "ts", ["id"], n).build(events, [FEATURES, [{"type": "average", "name": "again", "expression": "seen", "window": "last_2"}]])
    near(build(rows), build(None))


def test_fold_by_ranges(events):
    order = ["ts", "id"]
    near(I.fold_states(events, "u", order, "value", segment_rows=100), I.fold_states(events, "u", order, "value", segment_rows=None))
    mark = I.latest_state(I.fold_states(events.where("id < 500"), "u", order, "value"), "u", order, ["n", "total", "last", "low", "high"])
    near(I.fold_states(events.where("id >= 500"), "u", order, "value", mark, 100), I.fold_states(events.where("id >= 500"), "u", order, "value", mark, None))


def test_asof_by_ranges(events):
    right = events.where("kind = 'b' and ts is not null").groupBy("u", "ts").agg(F.max("id").alias("mark"))
    left = events.where("kind <> 'b'").select("u", "ts", "id")
    got, want = (I.asof(left, right, "u", "ts", "ts", ["mark"], n) for n in (100, None))
    near(got, want)
    assert 0 < got.where("mark is null").count() < got.count()


def test_no_window_of_a_hot_key_is_by_the_key_alone(events):
    plan = I.fold_states(events, "u", ["ts", "id"], "value", segment_rows=100)._jdf.queryExecution().toString()
    assert segments.SEG in plan
