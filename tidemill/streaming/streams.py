"""Structured Streaming over change and event feeds: watermarks, windows, deduplication, upserts, keyed state."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.incremental import key_upsert, partition_replace
from tidemill.sources.scratch import path_exists, scratch_path, stored
from tidemill.sources.snapshots import SnapshotTable, is_snapshot_table, read_snapshot

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def lateness(text: str) -> str:
    """A delay like 6h or 30m as Spark writes it."""
    m = re.fullmatch(r"(\d+)\s*([smhd])", text)
    if not m:
        raise ValueError(f"unknown lateness {text!r}")
    return f"{m[1]} {_UNITS[m[2]]}"


def file_stream(spark: SparkSession, folder: str, schema: Any, time: str, allowed: str | None = None, files_a_trigger: int | None = None, fmt: str = "parquet", pattern: str | None = None) -> DataFrame:
    """A stream of a folder's files; the time column, which may have no zone in files, becomes a timestamp, with a watermark on request."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    out = reader.load(folder).withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, lateness(allowed)) if allowed else out


#: Keeps state on disk, so that it may outgrow memory; the ordered folds need it.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(writer: DataStreamWriter, spark: SparkSession, out: str | None = None) -> None:
    """Runs a stream over all that there is."""
    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        writer = writer.trigger(availableNow=True)
        running = writer.start(out) if out else writer.start()
    finally:
        spark.conf.set(_STORE[0], before)
    running.awaitTermination()


def drained(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a streaming query over all there is, into a table in the shared folder, and returns its rows; none where nothing came.

    In complete mode each batch is the whole result. In update mode a batch has the keys that changed, so it
    replaces their rows.
    """
    spark = df.sparkSession
    base = scratch_path(spark, "stream")
    if mode == "append":
        _run(df.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append"), spark, f"{base}/out")
        return spark.read.schema(df.schema).parquet(f"{base}/out") if path_exists(spark, f"{base}/out") else spark.createDataFrame([], df.schema)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    for_each_batch(df, lambda batch, stream: upserted(batch, f"{base}/out", keys, stream) if mode == "update" else replaced(batch, f"{base}/out", stream), mode, f"{base}/state")
    return read_snapshot(spark, f"{base}/out") if is_snapshot_table(spark, f"{base}/out") else spark.createDataFrame([], df.schema)


def upserted(batch: DataFrame, path: str, keys: list[str], stream: tuple[str, int]) -> None:
    """A batch whose rows are one for each key."""
    SnapshotTable(batch.sparkSession, path, keys).upsert(batch, stream=stream)


def replaced(batch: DataFrame, path: str, stream: tuple[str, int]) -> None:
    SnapshotTable(batch.sparkSession, path).replace_all(batch, stream=stream)


def windowed_counts(df: DataFrame, time: str, length: str, slide: str | None = None, by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """start, by..., n and total of tumbling or sliding windows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return df.groupBy(w.alias("w"), *(by or [])).agg(*aggs).select(F.col("w.start").alias("start"), *(by or []), "n", *(["total"] if value else []))


def sessions(df: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """key, start, end, n of sessions that end after a gap."""
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each id within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def for_each_batch(df: DataFrame, put: Callable[[DataFrame, tuple[str, int]], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over all there is; put gets each batch and (the stream's checkpoint, the batch's number), which name the batch if it runs again."""
    state = checkpoint or scratch_path(df.sparkSession, "stream-state")
    _run(df.writeStream.foreachBatch(lambda batch, number: put(batch, (state, number))).option("checkpointLocation", state).outputMode(mode), df.sparkSession)


def stream_upsert(df: DataFrame, path: str, keys: list[str], order_by: list[str], partition: str | None = None, deleted: str | None = None, checkpoint: str | None = None) -> None:
    """Upserts every batch of a change feed into the table at the path, once, whatever runs again; with a checkpoint of one's own the stream can go on later."""
    for_each_batch(df, lambda batch, stream: key_upsert(batch, path, keys, order_by, partition, deleted=deleted, stream=stream) and None, checkpoint=checkpoint)


def stream_partitions(df: DataFrame, source: Callable[[DataFrame], DataFrame], path: str, by: str, checkpoint: str | None = None) -> None:
    """Every batch, late rows included, has the partitions it touches built anew from their source."""
    for_each_batch(df, lambda batch, stream: partition_replace(source(batch.select(by).distinct()), path, by, stream=stream) and None, checkpoint=checkpoint)


class StateProcessor:
    """Keyed state: what it holds (schema, a tuple's columns), how it begins and how an entity's new events, a frame, change it.

    An ordered processor gets an entity's events in order of time, whatever frames and batches they come in. One
    that isn't, whose state doesn't depend on the order, gets them as they come.
    """

    schema = ""
    ordered = True

    def __init__(self, value: str) -> None:
        self.value = value

    def start(self) -> tuple:
        raise NotImplementedError

    def apply(self, state: tuple, events: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def aggregates(self) -> list[Column] | None:
        """For a state that doesn't depend on the order and that Spark's aggregates can hold: one for each of its columns. Spark then keeps the state itself, without a call of apply for each entity and batch."""
        return None


class Totals(StateProcessor):
    """The number of events and the sum of a column."""

    schema = "n bigint, total double"
    ordered = False

    def start(self) -> tuple:
        return (0, 0.0)

    def apply(self, state: tuple, events: pd.DataFrame) -> tuple:
        return (state[0] + len(events), state[1] + float(events[self.value].sum()))

    def aggregates(self) -> list[Column] | None:
        return [F.count(F.lit(1)), F.coalesce(F.sum(number(self.value)), F.lit(0.0))]


def number(column: str) -> Column:
    """A column as doubles, null where it is NaN, as pandas skips these."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def entity_states(
    df: DataFrame, entity: str, time: str, value: str, processor: StateProcessor | None = None, tiebreak: list[str] | None = None, start: DataFrame | None = None, idle: str | None = None, buckets: int = 1024
) -> DataFrame:
    """entity and its state after each batch of events; the state goes on between batches, and begins with that of `start` (entity and the state's columns), such as a checkpoint's.

    Events for an ordered processor wait in the state until the watermark, which df needs, has passed them; a timer
    then folds them in order of time and tiebreak. Events that come after the watermark are dropped, as by
    Spark's windows. idle: an entity's state begins anew after more than so long without events, and is removed when the watermark has come so far.
    buckets: into how many groups an ordered processor's entities are dealt; a task holds one at a time. A stream that goes on keeps its number.
    """
    own = processor or Totals(value)
    kind = dict(df.dtypes)[entity]
    out = f"{entity} {kind}, {own.schema}"
    names = [c.split()[0] for c in own.schema.split(", ")]
    if not own.ordered and start is None and idle is None:
        if aggregates := own.aggregates():
            named = [a.cast(c.split()[1]).alias(n) for a, n, c in zip(aggregates, names, own.schema.split(", "), strict=True)]
            return df.groupBy(entity).agg(*named)

        def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            now = state.get if state.exists else own.start()
            for f in frames:
                now = own.apply(now, f)
            state.update(now)
            yield pd.DataFrame({entity: [key[0]], **{n: [v] for n, v in zip(names, now, strict=True)}})

        return df.groupBy(entity).applyInPandasWithState(fold, out, own.schema, "update", GroupStateTimeout.NoTimeout)
    bucket, micros = (_free_name([*df.columns, *names], n) for n in ("bucket", "micros"))
    # A missing entity has a bucket of its own, and a stand-in, as pandas would make doubles of longs among which one is missing.
    whole = lambda rows: rows.withColumn(entity, F.coalesce(F.col(entity), F.lit(0).cast(kind))) if kind == "bigint" else rows
    dealt = lambda rows: whole(rows.withColumn(bucket, F.when(F.isnull(entity), -1).otherwise(F.pmod(F.hash(entity), F.lit(buckets)))))
    wait = OrderedFold(own, entity, bucket, micros, tiebreak or [], df.drop(entity).columns, 1000 * _seconds(idle) if idle else None)
    begin = dealt(start.select(F.col(entity).cast(kind).alias(entity), *(F.col(n).cast("decimal(20,0)") if k in _INTEGRAL else F.col(n) for n, k in wait.kinds.items()))).groupBy(bucket) if start is not None else None
    return dealt(df.withColumn(micros, F.unix_micros(F.col(time).cast("timestamp")))).groupBy(bucket).transformWithStateInPandas(wait, out, "Update", "EventTime", begin)


_INTEGRAL = ("tinyint", "byte", "smallint", "short", "int", "integer", "bigint", "long")


def _free_name(columns: list[str], name: str) -> str:
    """A name that no column has."""
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def _seconds(text: str) -> int:
    n, unit = lateness(text).split()
    return int(n) * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]


class OrderedFold(StatefulProcessor):
    """The states of a bucket's entities, its events that wait for the watermark, and one timer: for the earliest of them, or the first entity's end.

    Spark asks for state over a socket, several times for each key and batch, which takes longer than the folds of an
    entity's few events. So a key is a bucket of entities, whose states are one value. Events wait in pieces that are cut by
    time, so that those that the watermark hasn't reached aren't read.
    """

    #: Events that a processor gets at a time, and those of a piece.
    FRAME = 10_000
    PIECE = 2_000

    def __init__(self, own: StateProcessor, entity: str, bucket: str, micros: str, tiebreak: list[str], columns: list[str], idle_ms: int | None) -> None:
        self.own, self.entity, self.bucket, self.micros, self.tiebreak, self.columns, self.idle_ms = own, entity, bucket, micros, tiebreak, columns, idle_ms
        self.kinds = {c.split()[0]: c.split(maxsplit=1)[1].lower() for c in own.schema.split(", ")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "states binary")
        self.waiting = handle.getMapState("waiting", "first bigint, last bigint, number bigint", "events binary")
        self.mark = handle.getValueState("mark", "timer bigint, pieces bigint")

    def _millis(self, events: pd.DataFrame) -> np.ndarray:
        """Milliseconds, rounded up: those that are at most the watermark's belong to times that are."""
        return -(-events[self.micros].to_numpy() // 1000)

    def _wait(self, events: pd.DataFrame, pieces: int) -> tuple[int, int]:
        """Puts events among those that wait; the first one's time, and the number of pieces since the bucket's beginning."""
        events = events.drop(columns=self.bucket).sort_values(self.micros, kind="stable")
        at = self._millis(events)
        for i in range(0, len(events), self.PIECE):
            piece = events.iloc[i : i + self.PIECE]
            self.waiting.updateValue((int(at[i]), int(at[i + len(piece) - 1]), pieces), (pickle.dumps({c: piece[c].to_numpy() for c in piece}, 5),))
            pieces += 1
        return int(at[0]), pieces

    def _known(self) -> dict:
        """Each entity's state, and the time of its last event, if it has come here."""
        known = self.states.get()
        return pickle.loads(known[0]) if known else {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer, pieces = self.mark.get() or (None, 0)
        at = timer
        for f in rows:
            first, pieces = self._wait(f, pieces)
            at = first if at is None else min(at, first)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.mark.update((at, pieces))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        _, pieces = self.mark.get()
        known, out = self._known(), None
        keys = list(self.waiting.keys())
        ends = [k[0] for k in keys if k[0] > passed]
        if reached := [k for k in keys if k[0] <= passed]:
            events = pd.concat([pd.DataFrame(pickle.loads(self.waiting.getValue(k)[0])) for k in reached], ignore_index=True)
            for k in reached:
                self.waiting.removeKey(k)
            due = self._millis(events) <= passed
            if not due.all():
                first, pieces = self._wait(events[~due].assign(**{self.bucket: 0}), pieces)
                ends.append(first)
            out = self._folded(events[due], known, key[0] < 0)
        if self.idle_ms is not None:
            known = {e: s for e, s in known.items() if s[1] is None or s[1] + self.idle_ms > passed}
            ends += [last + self.idle_ms for _, last in known.values() if last is not None]
        if known:
            self.states.update((pickle.dumps(known, 5),))
        else:
            self.states.clear()
        timer = min(ends, default=None)
        if timer is not None:
            self.handle.registerTimer(timer)
        self.mark.update((timer, pieces))
        if out is not None:
            yield out

    def _folded(self, due: pd.DataFrame, known: dict, missing: bool) -> pd.DataFrame:
        """Folds events in order into the states of their entities, and returns these. missing: they have no entity."""
        codes, names = pd.factorize(pd.Series(0, due.index) if missing else due[self.entity], use_na_sentinel=False)
        due = due.assign(**{self.bucket: codes}).sort_values([self.bucket, self.micros, *self.tiebreak], kind="stable")
        codes, at, events = due[self.bucket].to_numpy(), self._millis(due), due[self.columns]
        names = [None if missing or n != n else n for n in names.tolist()]
        begins = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
        now = {}
        for a, b in zip(begins, [*begins[1:], len(due)], strict=True):
            name = names[codes[a]]
            state, last = known.get(name) or (self.own.start(), None)
            for i, j, anew in self._runs(at, a, b, last):
                state = self.own.start() if anew else state
                for k in range(i, j, self.FRAME):
                    state = self.own.apply(state, events.iloc[k : min(k + self.FRAME, j)])
            known[name] = now[name] = (tuple(state), int(at[b - 1]))
        columns = zip(*(s for s, _ in now.values()), strict=True)
        # Among objects, whole numbers stay what they are beside missing ones.
        return pd.DataFrame({self.entity: list(now), **{n: pd.Series(list(v), dtype=object if k in _INTEGRAL else None) for (n, k), v in zip(self.kinds.items(), columns, strict=True)}})

    def _runs(self, at: np.ndarray, a: int, b: int, last: int | None) -> list[tuple[int, int, bool]]:
        """An entity's events from a to b, cut where it was idle for too long before the next ones; with whether its state begins anew."""
        if self.idle_ms is None:
            return [(a, b, False)]
        gaps = (a + np.flatnonzero(np.diff(at[a:b], prepend=at[a] if last is None else last) > self.idle_ms)).tolist()
        cuts = sorted({a, *gaps})
        return [(i, j, i in gaps) for i, j in zip(cuts, [*cuts[1:], b], strict=True)]

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        known, names = self._known(), [None] * len(initialState) if key[0] < 0 else initialState[self.entity].tolist()
        columns = [[None if gone else int(v) if k in _INTEGRAL else v for v, gone in zip(initialState[n].tolist(), initialState[n].isna(), strict=True)] for n, k in self.kinds.items()]
        for name, *state in zip(names, *columns, strict=True):
            known[None if name != name else name] = (tuple(state), None)
        self.states.update((pickle.dumps(known, 5),))

    def close(self) -> None:
        pass


def persist_states(states: DataFrame, base: str, entity: str, every: int = 10) -> None:
    """Keeps a stream of states (in update mode) as latest, the state of each entity; history/batch=N, those that a batch changed; and a checkpoint after each `every` batches, a snapshot of latest that keeps its name.

    A batch that runs again replaces what it wrote, so reruns after a failure leave the same tables.
    """
    spark = states.sparkSession
    latest = SnapshotTable(spark, f"{base}/latest", [entity])

    def put(batch: DataFrame, stream: tuple[str, int]) -> None:
        rows, number = stored(batch, "states"), stream[1]
        rows.write.mode("overwrite").parquet(f"{base}/history/batch={number}")
        latest.upsert(rows, stream=stream)
        if (number + 1) % every == 0:
            latest.tag(f"batch={number}")

    for_each_batch(states, put, "update", f"{base}/stream")


def checkpoints(spark: SparkSession, base: str) -> list[int]:
    """The batches after which persist_states has kept a checkpoint."""
    return sorted(int(t.removeprefix("batch=")) for t in SnapshotTable(spark, f"{base}/latest").snapshot()["tags"])


def checkpoint(spark: SparkSession, base: str, batch: int | None = None) -> DataFrame:
    """The states of a checkpoint, the last one by default: a start for entity_states and for fold_states."""
    known = checkpoints(spark, base)
    if not known or batch is not None and batch not in known:
        raise FileNotFoundError(f"{base} has checkpoints after the batches {known}")
    return SnapshotTable(spark, f"{base}/latest").read(tag=f"batch={known[-1] if batch is None else batch}")
