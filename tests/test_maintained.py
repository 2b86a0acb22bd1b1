"""Maintained aggregates against full builds, and feeds that come again."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.operators.incremental import change_events
from tidemill.operators.maintained import AggregateView, take_changes
from tidemill.sources.snapshots import ConflictError, SnapshotTable

ROW = "id bigint, g bigint, h string, v bigint, w decimal(10,2)"
KINDS = {"c": ("count", "v"), "s": ("sum", "v"), "m": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "ws": ("sum", "w"), "wl": ("min", "w")}


def built(df):
    return df.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("c"), F.sum("v").alias("s"), F.avg("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("ws"), F.min("w").alias("wl"))


def test_refreshes_equal_full_builds(spark, tmp_path):
    r, have, number = random.Random(1), {}, 0
    view = AggregateView(spark, f"{tmp_path}/v", ["g", "h"], KINDS, buckets=3)
    frame = lambda x: spark.createDataFrame([(*a[:4], None if a[4] is None else Decimal(a[4])) for a in x], ROW)
    again = []
    for step in range(6):
        new = [(number + i, r.choice([None, *range(6)]), r.choice(["a", None]), r.choice([None, *range(-9, 9)]), None if r.random() < 0.2 else r.randrange(1000)) for i in range(40 if step != 4 else 0)]
        number += len(new)
        gone = r.sample(sorted(have), len(have) // 3) if step else []
        deletes = [have.pop(i) for i in gone]
        if step == 5:  # a whole group goes, and a row that comes and goes at once
            deletes += [have.pop(i) for i in [i for i, x in have.items() if x[1] == 2]]
            new = [x for x in new if x[1] != 2]
            deletes.append((99999, 1, "a", -100, 1))
            new.append((99999, 1, "a", -100, 1))
        have |= {x[0]: x for x in new if x[0] != 99999}
        again.append(view.refresh(frame(new), frame(deletes), frame(list(have.values()))))
        want = sorted(map(str, built(frame(list(have.values()))).collect()))
        assert sorted(map(str, view.read().select("g", "h", "n", *KINDS).collect())) == want
    assert again[0] == 0 and 0 < sum(again) < 6 * 14
    view.rebuild(frame(list(have.values())))
    assert sorted(map(str, view.read().select("g", "h", "n", *KINDS).collect())) == want
    with pytest.raises(ValueError, match="median"):
        AggregateView(spark, "x", ["g"], {"m": ("median", "v")})


def test_a_refresh_reads_the_touched_groups_only(spark, tmp_path):
    df = spark.range(1000).select("id", F.col("id").alias("g"), F.lit("a").alias("h"), F.col("id").alias("v"), F.lit(1).cast("decimal(10,2)").alias("w"))
    view = AggregateView(spark, f"{tmp_path}/v", ["g", "h"], KINDS, buckets=16)
    view.rebuild(df)
    one = spark.createDataFrame([(5000, 7, "a", 1, None)], ROW)
    assert len(view.table.units_of(one)) == 1
    view.refresh(one, spark.createDataFrame([], ROW), df.union(one))
    s = view.table.snapshot()
    assert sum(len(x["deltas"]) for x in s["units"].values()) == 1 and view.read().where("g = 7").first().n == 2


def test_a_feed_that_comes_again(spark, tmp_path, monkeypatch):
    feed = lambda *ids: change_events(spark.createDataFrame([("raw", {"id": str(i)}, i) for i in ids], "source string, primary_key map<string,string>, at bigint"))
    path = f"{tmp_path}/ledger"
    assert take_changes(feed(1, 2, 2), path, 4).count() == 2
    assert sorted(r["at"] for r in take_changes(feed(2, 3, 4), path, 4).collect()) == [3, 4]
    for _ in range(2):
        assert take_changes(feed(1, 2, 3, 4), path, 4).count() == 0
    assert SnapshotTable(spark, path).read().count() == 4 and take_changes(feed(), path, 4).count() == 0
    # Another writer's commit in between is noticed.
    real, other = SnapshotTable._put, []

    def put(self, entry):
        if not other:
            other.append(True)
            take_changes(feed(9), path, 4)
            return False
        return real(self, entry)

    monkeypatch.setattr(SnapshotTable, "_put", put)
    with pytest.raises(ConflictError):
        take_changes(feed(9, 10), path, 4)
    assert take_changes(feed(9, 10), path, 4).count() == 1
