"""Snapshot tables: merges on read, interrupted and repeated commits, conflicts, tags; ordered streaming state."""

import datetime as dt
import os
import random

import pytest

from tidemill.operators import incremental as I
from tidemill.sources import readers as R
from tidemill.sources import snapshots
from tidemill.sources import writers as W
from tidemill.sources.snapshots import ConflictError, SnapshotTable
from tidemill.streaming import streams as S


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def pairs(spark, *x):
    return spark.createDataFrame(x, "id bigint, v string")


class Stopped(Exception):
    pass


STEPS = ["files", "entry", "before rename", "after rename", "compaction files", "compaction entry"]


@pytest.mark.parametrize("step", STEPS)
def test_a_commit_stopped_at_any_step_is_whole_or_not_there(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/t"
    table = lambda: SnapshotTable(spark, path, ["id"], buckets=2, most_deltas=1)
    table().upsert(pairs(spark, *((i, "old") for i in range(100))))
    table().upsert(pairs(spark, (0, "older"), (1, "older")))
    before = rows(table().read(), "id")
    new = pairs(spark, *((i, "new") for i in range(0, 100, 2)), (1000, "new"))
    want = sorted([(i, "new" if i % 2 == 0 else "older" if i == 1 else "old") for i in range(100)] + [(1000, "new")])
    puts = [0]
    real_put, real_text, real_rename = SnapshotTable._put, snapshots.write_text, snapshots.rename_new

    def count(self, entry):
        puts[0] += 1
        return real_put(self, entry)

    def write_text(spark_, where, text):
        if step == "entry" or step == "compaction entry" and puts[0] == 2:
            real_text(spark_, where, text[: len(text) // 2])
            raise Stopped
        real_text(spark_, where, text)

    def rename_new(spark_, old, there):
        if step == "before rename" or step == "compaction files" and puts[0] == 2:
            raise Stopped
        done = real_rename(spark_, old, there)
        if step == "after rename":
            raise Stopped
        return done

    def files(self):
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_put", count)
        m.setattr(snapshots, "write_text", write_text)
        m.setattr(snapshots, "rename_new", rename_new)
        if step == "files":
            m.setattr(SnapshotTable, "_put", lambda self, entry: files(self))
        with pytest.raises(Stopped):
            table().upsert(new)
    got = rows(table().read(), "id")
    assert got == (before if step in ("files", "entry", "before rename") else want)
    # What comes after finds the table as it is, and loses nothing.
    table().upsert(new)
    assert rows(table().read(), "id") == want
    table().vacuum(1)
    assert rows(table().read(), "id") == want and not [n for n in os.listdir(f"{path}/_log") if n.startswith(".") and not n.endswith(".crc")]


def test_an_upsert_writes_its_own_keys_only(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], buckets=4, most_deltas=8)
    t.upsert(pairs(spark, *((i, "a") for i in range(5000))))
    for i in range(3):
        name = t.upsert(pairs(spark, (i, "b"), (9000 + i, "b")))
        assert t.committed(name).count() == 2 and t.snapshot()["operation"] == "upsert"
        assert spark.read.parquet(f"{t.path}/_data/__commit={name}").count() == 2
    assert t.read().count() == 5003
    for i in range(60):
        t.upsert(pairs(spark, (i, "c")))
    assert max(len(x["deltas"]) for x in t.snapshot()["units"].values()) <= 8 and t.read().where("v = 'c'").count() == 60 and t.read().count() == 5003


def test_random_changes_against_a_dict(spark, tmp_path):
    r, have = random.Random(4), {}
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id", "p"], buckets=3, most_deltas=2)
    versions = {}
    for n in range(12):
        batch = {(r.choice([None, 1, 2, 3, 4, 5]), r.choice(["x", "y", None])): (r.random() < 0.3, f"{n}") for _ in range(6)}
        t.upsert(spark.createDataFrame([(*k, v, gone) for k, (gone, v) in batch.items()], "id bigint, p string, v string, gone boolean"), deleted="gone")
        for k, (gone, v) in batch.items():
            have.pop(k, None) if gone else have.update({k: v})
        versions[t.snapshot()["version"]] = dict(have)
        assert {(a, b): c for a, b, c in t.read().collect()} == have
    for v, then in versions.items():
        assert {(a, b): c for a, b, c in t.read(v).collect()} == then


def test_columns_that_come_later(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], buckets=2)
    t.upsert(pairs(spark, (1, "a"), (2, "b")))
    t.upsert(spark.createDataFrame([(2, 5.0)], "id int, w double"))
    t.upsert(pairs(spark))
    assert rows(t.read().select("id", "v", "w"), "id") == [(1, "a", None), (2, None, 5.0)] and dict(t.read().dtypes)["id"] == "bigint"


def test_conflicts(spark, tmp_path, monkeypatch):
    """Two writers take the same number: the second one's delta lies on the first one's; a replaced unit stops a compaction."""
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], buckets=1, most_deltas=9)
    t.upsert(pairs(spark, (1, "a"), (2, "a")))
    real, other = SnapshotTable._put, []

    def put(self, entry):
        if not other:
            other.append(True)
            SnapshotTable(spark, t.path, ["id"]).upsert(pairs(spark, (1, "first"), (3, "first")))
        return real(self, entry)

    monkeypatch.setattr(SnapshotTable, "_put", put)
    t.upsert(pairs(spark, (1, "second")))
    assert rows(t.read(), "id") == [(1, "second"), (2, "a"), (3, "first")] and t.versions() == [0, 1, 2]
    other.clear()

    def replacing(self, entry):
        if not other:
            other.append(True)
            SnapshotTable(spark, t.path, ["id"]).replace_all(pairs(spark, (7, "whole")))
        return real(self, entry)

    monkeypatch.setattr(SnapshotTable, "_put", replacing)
    with pytest.raises(ConflictError):
        t.compact()
    assert rows(t.read(), "id") == [(7, "whole")]


def test_a_stream_batch_counts_once(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"])
    assert t.upsert(pairs(spark, (1, "a")), stream=("s", 0)) and t.upsert(pairs(spark, (1, "b")), stream=("s", 1))
    assert t.upsert(pairs(spark, (1, "a")), stream=("s", 0)) is None and t.upsert(pairs(spark, (1, "x")), stream=("other", 0))
    assert rows(t.read()) == [(1, "x")]
    assert I.key_upsert(pairs(spark, (5, "z")), t.path, ["id"], ["id"], stream=("s", 1)).first()[0] == 1


def test_tags_outlive_a_vacuum(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], buckets=1, most_deltas=1)
    t.upsert(pairs(spark, (1, "a")))
    t.tag("first")
    for i in range(5):
        t.upsert(pairs(spark, (1, f"b{i}")))
    assert t.vacuum(1) > 0 and rows(t.read(tag="first")) == [(1, "a")] and rows(t.read()) == [(1, "b4")]


def test_plain_files_become_a_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    pairs(spark, *((i, "plain") for i in range(100))).write.parquet(path)
    real = SnapshotTable._put
    monkeypatch.setattr(SnapshotTable, "_put", lambda self, entry: (_ for _ in ()).throw(Stopped))
    with pytest.raises(Stopped):
        I.key_upsert(pairs(spark, (1, "new")), path, ["id"], ["v"])
    assert R.read_files(spark, path).count() == 100
    monkeypatch.setattr(SnapshotTable, "_put", real)
    assert I.key_upsert(pairs(spark, (1, "new"), (200, "new")), path, ["id"], ["v"]).first()[0] == 101
    assert sorted(os.listdir(path)) == ["_data", "_log"]
    with pytest.raises(ValueError, match="keys"):
        I.key_upsert(pairs(spark, (1, "new")), path, ["v"], ["id"])


def test_partitions_of_odd_names(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda *x: spark.createDataFrame(x, "p string, n int")
    W.write_partitioned(make(("a/b", 1), ("", 2), (None, 3), ("ä %=", 4)), path, by="p", atomic=True)
    W.write_partitioned(make(("a/b", 10), ("", 20)), path, by="p", atomic=True)
    W.write_partitioned(make((None, 30), ("ä %=", 40)), path, by="p", atomic=True, sort_by=["n DESC"])
    assert rows(R.read_files(spark, path), "n") == [("a/b", 10), ("", 20), (None, 30), ("ä %=", 40)]


def chain():
    """A processor whose state depends on the order; made here, as workers can't import a test's module."""

    class Chain(S.StateProcessor):
        schema = "n bigint, last double, falls bigint"

        def start(self):
            return (0, None, 0)

        def apply(self, state, events):
            n, last, falls = state
            for v in events[self.value].tolist():
                n, last, falls = n + 1, v, falls + int(last is not None and v < last)
            return (n, last, falls)

    return Chain("value")


def event_stream(spark, folder, batches, allowed="1h"):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "id bigint, ts timestamp, value double").coalesce(1).write.parquet(f"{folder}/f{i}")
    return S.file_stream(spark, f"{folder}/*", "id bigint, ts timestamp, value double", "ts", allowed, 1)


def test_ordered_state(spark, tmp_path):
    """Events in reverse, more of them than a frame holds, over batches; states go on from a checkpoint."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda i: t0 + dt.timedelta(seconds=i)
    first = [[(1, at(i), float(i)) for i in reversed(range(0, 1000, 2))], [(1, at(i), float(i)) for i in reversed(range(1, 1000, 2))] + [(2, at(500), 7.0)], [(3, at(9000), 0.0)]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        stream = event_stream(spark, f"{tmp_path}/a", first)
        S.persist_states(S.entity_states(stream, "id", "ts", "value", chain()), f"{tmp_path}/s", "id", every=1)
        assert rows(S.checkpoint(spark, f"{tmp_path}/s"), "id") == [(1, 1000, 999.0, 0), (2, 1, 7.0, 0)]
        more = [[(1, at(20_001), 5.0), (1, at(20_000), 2000.0), (2, at(20_000), 1.0)], [(9, at(40_000), 0.0)]]
        go_on = S.entity_states(event_stream(spark, f"{tmp_path}/b", more), "id", "ts", "value", chain(), start=S.checkpoint(spark, f"{tmp_path}/s"))
        assert rows(S.drained(go_on, "update", ["id"]), "id") == [(1, 1002, 5.0, 1), (2, 2, 1.0, 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_idle_entities_are_forgotten(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    day = lambda d, i=1: (i, t0 + dt.timedelta(days=d), float(d))
    stream = event_stream(spark, f"{tmp_path}/a", [[day(0)], [day(1, 5)], [day(2)], [day(20, 5)], [day(21)], [day(30, 5)], [day(40, 5)]])
    out = S.drained(S.entity_states(stream, "id", "ts", "value", chain(), idle="7d"), "update", ["id"])
    assert rows(out.where("id = 1")) == [(1, 1, 21.0, 0)]  # the events of the first days are no part of it


def test_ordered_states_are_kept_by_bucket(spark, tmp_path):
    """Many entities, a missing one and large ids beside it, in few keys of Spark's state; more events than a piece holds."""
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    ids = [None, *(2**60 + i for i in range(400))]
    event = lambda b: (rng.choice(ids), t0 + dt.timedelta(hours=10 * b, microseconds=rng.randrange(54_000_000_000)), rng.randrange(1000) / 8)
    batches = [[event(b) for _ in range(6000)] for b in range(4)]
    batches.append([(ids[1], t0 + dt.timedelta(days=9), 0.0)])
    states, out = {}, {}

    def put(batch, stream):
        new = batch.collect()
        assert len(new) == len({r[0] for r in new})
        out.update({r[0]: tuple(r)[1:] for r in new})

    stream = event_stream(spark, f"{tmp_path}/a", batches, "6h")
    S.for_each_batch(S.entity_states(stream, "id", "ts", "value", chain(), buckets=2), put, "update", f"{tmp_path}/state")
    for i, _, v in sorted((e for b in batches[:-1] for e in b), key=lambda e: e[1]):
        n, last, falls = states.get(i, (0, None, 0))
        states[i] = (n + 1, v, falls + int(last is not None and v < last))
    assert out == states and len(states) == len(ids)
    kept = spark.read.format("statestore").option("stateVarName", "states").load(f"{tmp_path}/state")
    assert kept.count() == 3


def test_an_event_at_the_watermark_is_folded(spark, tmp_path):
    """Also where another one of its bucket comes a millisecond later, which waits and isn't lost."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda ms: t0 + dt.timedelta(milliseconds=ms)
    stream = event_stream(spark, f"{tmp_path}/a", [[(1, at(0), 1.0)], [(2, at(1), 2.0), (3, at(3_600_000), 3.0)], [(3, at(3_600_001), 4.0)]])
    out, log = S.entity_states(stream, "id", "ts", "value", chain(), buckets=1), []
    S.for_each_batch(out, lambda batch, _: log.append(rows(batch.select("id", "n"), "id")), "update")
    assert [b for b in log if b] == [[(1, 1)], [(2, 1)]]
