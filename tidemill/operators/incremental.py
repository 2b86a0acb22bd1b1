"""Change events, affected keys, propagation along dependencies, and the materialisers that use them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import ordering
from tidemill.operators import segments
from tidemill.sources.snapshots import SnapshotTable

MAPS = ("primary_key", "partition_keys", "entity_keys")


def change_events(df: DataFrame) -> DataFrame:
    """Normalised events: source_name (or source), change_type (upsert if missing), the three key maps; a missing source is an error value."""
    names = [F.col(c) for c in ("source_name", "source") if c in df.columns]
    if not names:
        raise ValueError("change events need source_name or source")
    source = F.coalesce(*names, F.raise_error(F.lit("a change event has no source")).cast("string"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    maps = {m: F.coalesce(F.col(m), empty) if m in df.columns else empty for m in MAPS}
    kind = F.coalesce(F.col("change_type"), F.lit("upsert")) if "change_type" in df.columns else F.lit("upsert")
    key = F.col("idempotency_key") if "idempotency_key" in df.columns else F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in ("source", "source_name", "change_type", "idempotency_key", *MAPS)]
    return df.select(source.alias("source_name"), kind.alias("change_type"), *[c.alias(m) for m, c in maps.items()], key.alias("idempotency_key"), *rest)


def change_id() -> Column:
    """The idempotency key, else source:type:sorted primary key as JSON."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries("primary_key")))
    return F.coalesce("idempotency_key", F.concat_ws(":", "source_name", "change_type", F.to_json(ordered)))


def grain_keys(grain: str, columns: Iterable[str]) -> Column:
    """The map of a grain's columns: entity keys for entity, primary then partition then entity for key, partition then primary for partition, all of them otherwise."""
    order = {"entity": ("entity_keys",), "key": ("primary_key", "partition_keys", "entity_keys"), "partition": ("partition_keys", "primary_key")}.get(grain, ("entity_keys", "partition_keys", "primary_key"))
    pairs = [F.struct(F.lit(c).alias("key"), F.coalesce(*[F.try_element_at(m, F.lit(c)) for m in order]).alias("value")) for c in columns]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def affected_keys(events: DataFrame, node: str, grain: str, columns: list[str]) -> DataFrame:
    """Distinct (node, grain, keys) that the events touch; keys is a map, as sorted JSON too for comparisons."""
    out = events.select(F.lit(node).alias("node"), F.lit(grain).alias("grain"), grain_keys(grain, sorted(columns)).alias("keys"))
    return out.where(F.size("keys") > 0).withColumn("key_json", F.to_json("keys")).dropDuplicates(["node", "grain", "key_json"])


def routes(edges: list[Mapping[str, Any]]) -> dict[str, list[tuple[str, str, tuple[tuple[str, str], ...]]]]:
    """For each node all (node, grain, key renames) that it reaches, with the renames of a path put together.

    There are finitely many renames, so cycles of the graph come to an end.
    """
    out: dict[str, list] = {}
    for start in {e["from"] for e in edges}:
        seen, todo = [], [(start, None)]
        while todo:
            node, names = todo.pop()
            for e in edges:
                if e["from"] == node:
                    steps = e["key_mapping"]
                    new = dict(steps) if names is None else {a: steps[b] for a, b in names.items() if b in steps}
                    one = (e["to"], e["mode"], tuple(sorted(new.items(), key=lambda p: p[1])))
                    if new and one not in seen:
                        seen.append(one)
                        todo.append((e["to"], new))
        out[start] = seen
    return out


def propagate(start: DataFrame, edges: list[Mapping[str, Any]]) -> DataFrame:
    """Work units (node, grain, keys, key_json) reached from the starting ones, these included.

    edges: {from, to, mode: partition | key | entity, key_mapping: {column of from: column of to}}. They are
    few and declared, so all ways through them are a constant table: each unit looks its node up, and one
    aggregation removes repeats.
    """
    ways = {node: found for node, found in routes(edges).items() if found}
    units = start.select("node", "grain", "keys")
    if ways:
        pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
        way = lambda to, mode, names: F.struct(F.lit(to).alias("to"), F.lit(mode).alias("mode"), F.array(*[pair(a, b) for a, b in names]).alias("names"))
        known = F.create_map(*[c for node, found in sorted(ways.items()) for c in (F.lit(node), F.array(*[way(*w) for w in found]))])
        entries = F.transform("w.names", lambda p: F.struct(p["b"].alias("key"), F.try_element_at("keys", p["a"]).alias("value")))
        keys = F.map_from_entries(F.filter(entries, lambda p: p["value"].isNotNull()))
        reached = units.select("keys", F.explode(known[F.col("node")]).alias("w")).select(F.col("w.to").alias("node"), F.col("w.mode").alias("grain"), keys.alias("keys"))
        units = units.union(reached.where(F.size("keys") > 0))
    return units.withColumn("key_json", F.to_json("keys")).dropDuplicates(["node", "grain", "key_json"])


def touched(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def keep_last(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The last row of each key by order_by; without keys, all rows.

    Where all orders go one way it is a partial aggregation, which no hot key gathers in one task.
    """
    if not keys:
        return df
    down, names = {o.upper().endswith(" DESC") for o in order_by}, [o.split()[0] for o in order_by]
    if len(down) == 1:
        pick = F.min_by if down.pop() else F.max_by
        rest = [F.col(f"`{c}`") for c in df.columns]
        return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*names)).alias("__row")).select("__row.*")
    order = [F.col(o.split()[0]).asc_nulls_first() if o.upper().endswith(" DESC") else F.col(o.split()[0]).desc_nulls_last() for o in order_by]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def partition_replace(df: DataFrame, path: str, by: str, sort_by: list[str] | None = None, stream: tuple[str, int] | None = None) -> DataFrame:
    """Replaces the partitions that df has rows of, in one commit; returns them with their row counts."""
    t = SnapshotTable(df.sparkSession, path, partition=by)
    t.adopt()
    return t.committed(t.replace_units(df, sort_by, stream)).groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


def key_upsert(
    incoming: DataFrame, path: str, keys: list[str], order_by: list[str], partition: str | None = None, global_key: bool = False, deleted: str | None = None, stream: tuple[str, int] | None = None
) -> DataFrame:
    """Incoming rows, the last of each key, replace existing rows of their keys, in one commit; returns the touched partitions or one row with the row count.

    A commit writes the incoming rows only; with a partition, keys are those of a partition, and global_key also
    removes the old row of a key that came to another one. Rows whose boolean column `deleted` is true remove
    their keys. Without keys the incoming rows become the table. A stream's batch, (name, number), counts once.
    """
    t = SnapshotTable(incoming.sparkSession, path, keys, partition)
    t.adopt()
    if keys:
        name = t.upsert(keep_last(incoming, keys, order_by), deleted, global_key and partition is not None, stream)
    else:
        name = t.replace_all(incoming, stream=stream)
    if partition:
        return touched(t.committed(name), partition)
    return t.read().agg(F.count(F.lit(1)).alias("rows"))


def materialise(df: DataFrame, strategy: str, path: str, **options: Any) -> DataFrame | None:
    """full_refresh, partition_replace, key_upsert or entity_state_update."""
    if strategy == "full_refresh":
        t = SnapshotTable(df.sparkSession, path)
        t.adopt()
        t.replace_all(df)
        return None
    if strategy == "partition_replace":
        return partition_replace(df, path, options["partition"], options.get("sort_by"))
    if strategy in ("key_upsert", "entity_state_update"):
        return key_upsert(df, path, options["keys"], options["order_by"], options.get("partition"), options.get("global_key", False))
    raise ValueError(f"unknown strategy {strategy!r}")


MANIFEST = "manifest_version string, pipeline string, source string, normalized_dataset string, run_id string, produced_at string, mode string, changes array<struct<source:string,change_type:string,grain:string,primary_key:map<string,string>,partition_keys:map<string,string>,entity_keys:map<string,string>>>"


def build_manifests(changes: DataFrame, header: Mapping[str, str], by: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """run_id, record_count and manifest (JSON) of changes (source, change_type, grain and the key maps), by the given columns.

    A manifest has about `most` changes: those of a group are dealt to as many manifests as they need, so no
    document grows with its group.
    """
    by = by or []
    names = ["source", "change_type", "grain", *MAPS]
    keyed = changes.select(*by, F.lit(0).alias("__all"), F.to_json(F.struct(*names)).alias("c"))
    groups = [*by, "__all"]
    sizes = keyed.groupBy(*[F.col(c).alias(f"__{c}") for c in groups]).agg(F.count(F.lit(1)).alias("n"))
    rows = keyed.join(sizes, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in groups]).select(*by, "c", F.pmod(F.xxhash64("c"), F.ceil(F.col("n") / most)).cast("int").alias("part"))
    run_id = F.concat_ws("-", *[F.col(c).cast("string") for c in by], F.col("part").cast("string"))
    out = rows.groupBy(*by, "part").agg(F.array_sort(F.collect_list("c")).alias("all"))
    head = F.to_json(F.struct(F.lit("1").alias("manifest_version"), *[F.lit(v).alias(k) for k, v in header.items()], run_id.alias("run_id")))
    whole = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"changes":['), F.array_join("all", ","), F.lit("]}"))
    return out.select(*by, run_id.alias("run_id"), F.size("all").cast("long").alias("record_count"), whole.alias("manifest"))


def manifest_changes(df: DataFrame, column: str = "manifest") -> DataFrame:
    """One row for each change of JSON manifests, with the header's run_id."""
    m = df.select(F.from_json(column, MANIFEST).alias("m"))
    return m.select("m.pipeline", "m.run_id", F.explode("m.changes").alias("c")).select("pipeline", "run_id", "c.*")


def manifest_values(changes: DataFrame, key: str) -> DataFrame:
    """Distinct values of a key in the changes' primary, partition or entity keys."""
    return changes.select(F.coalesce(*[F.try_element_at(m, F.lit(key)) for m in MAPS]).alias(key)).where(F.col(key).isNotNull()).distinct()


_FOLD = (("n", "count"), ("total", "sum"), ("low", "min"), ("high", "max"))


def fold_states(events: DataFrame, entity: str, order_by: list[str], value: str, start: DataFrame | None = None, segment_rows: int | None = segments.SEGMENT_ROWS) -> DataFrame:
    """The state after each event: n, total, last, low, high per entity, going on from a checkpoint (entity, n, total, last, low, high).

    An entity of more than segment_rows events is cut into time ranges, each folded by itself; a state's parts
    are associative, so what the ranges before hold together is added to it.
    """
    v = F.col(value)
    fold = lambda name: {"count": F.count(F.lit(1)), "sum": F.sum(v), "min": F.min(v), "max": F.max(v)}[name]
    w = Window.partitionBy(entity).orderBy(*ordering(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda df: df.withColumns({n: fold(kind).over(w) for n, kind in _FOLD})
    cuts = segments.hot_cuts(events, entity, order_by[0], segment_rows) if segment_rows else None
    if cuts is None:
        out = whole(events)
    else:
        cold, hot = segments.parted(events, entity, order_by[0], cuts)
        hot = segments.running(hot, [entity], order_by, [(n, kind, F.lit(1) if kind == "count" else v) for n, kind in _FOLD], own=True)
        out = whole(cold).unionByName(hot.drop(segments.SEG))
    out = out.withColumn("last", v)
    if start is None:
        return out
    s = start.select(F.col(entity).alias("__e"), *[F.col(c).alias(f"__{c}") for c, _ in _FOLD])
    out = out.join(s, out[entity] == s["__e"], "left")
    return out.withColumns({
        "n": F.col("n") + F.coalesce("__n", F.lit(0)), "total": F.col("total") + F.coalesce("__total", F.lit(0.0)),
        "low": F.least("low", "__low"), "high": F.greatest("high", "__high"),
    }).drop("__e", "__n", "__total", "__low", "__high")


def latest_state(states: DataFrame, entity: str, order_by: list[str], columns: list[str]) -> DataFrame:
    """The last state of each entity; partial aggregation, no sort."""
    return states.groupBy(entity).agg(F.max_by(F.struct(*columns), F.struct(*order_by)).alias("s")).select(entity, "s.*")


def asof(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, columns: list[str], segment_rows: int | None = segments.SEGMENT_ROWS) -> DataFrame:
    """left with the columns of the last right row of its key at or before its time (right times unique by key).

    Both sides are merged by time and carried forward, so no pair of rows is made. A key of more than
    segment_rows rows is dealt out by time, and the last right row of the ranges before is carried into each.
    """
    extra = F.struct(*[F.col(c) for c in columns])
    own = left.select(F.col(by).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(extra.alias("e")).schema[0].dataType).alias("__r"))
    other = right.select(F.col(by).alias("__k"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(own.schema["__l"].dataType).alias("__l"), extra.alias("__r"))
    both = own.unionByName(other)
    w = Window.partitionBy("__k").orderBy(F.col("__t").asc_nulls_last(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    merged = lambda df: df.withColumn("__r", F.last("__r", True).over(w))
    cuts = segments.hot_cuts(both.select("__k", "__t"), "__k", "__t", segment_rows) if segment_rows else None
    if cuts is None:
        out = merged(both)
    else:
        cold, hot = segments.parted(both, "__k", "__t", cuts)
        hot = segments.running(hot, ["__k"], ["__t", "__side"], [("__now", "last", F.col("__r"))], own=True)
        out = merged(cold).unionByName(hot.drop("__r", segments.SEG).withColumnRenamed("__now", "__r"))
    # A row without a time has no row before it.
    known = F.when(F.col("__t").isNotNull(), F.col("__r"))
    return out.where("__side = 1").withColumn("__r", known).select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in columns])
