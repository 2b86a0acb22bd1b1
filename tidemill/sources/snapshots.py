"""Tables whose commits are whole or not at all: numbered snapshots, upserts as deltas, merged on read.

A table is a folder with _data/__commit=C/__unit=U/*.parquet and _log/N.json. A log entry is a snapshot: the
schema, the keys, and for each unit (a partition's value, or a hash bucket of the keys) the commit of its base
and those of its deltas. The newest entry is the table.

- A commit writes its files under a name of its own, then its entry, which a rename puts in place if no other
  commit has taken that number; then it takes the next number and tries again. What a crash leaves behind is a
  folder that no entry names, or an entry under a temporary name, and readers see neither.
- An upsert writes only its own keys, to the units that they fall into. Readers take the last delta of a key and
  the base's other keys; units without deltas are read as they are. A unit with more than `most_deltas` deltas
  is merged into a new base after the commit.
- A stream's commits carry its name and batch number, so a batch that runs again changes nothing.
- A tag keeps a snapshot under a name; vacuum() removes what neither the last snapshots nor tags need.

A folder of plain parquet files becomes a table with the first commit to it: its rows are the first base, and
the plain files go after that. The file system must have an atomic rename that doesn't replace (local disks,
HDFS and most cloud file systems in hierarchical mode have).

Nulls in keys equal each other. Column names that begin with __ are the table's own. Columns that come later are null in earlier rows; known columns keep their
types. The log's size depends on the number of units and their deltas, not on rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from contextlib import suppress
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.functions.exprs import ordering
from tidemill.sources.scratch import child_names, make_dir, path_exists, read_text, remove_path, rename_new, rename_path, write_text

DATA, LOG = "_data", "_log"
#: Columns of the files besides the table's: the commit and unit are folders.
DELETED, COMMIT, UNIT = "__deleted", "__commit", "__unit"
BUCKETS, MOST_DELTAS, TRIES = 16, 8, 20

Snapshot = dict[str, Any]


class ConflictError(RuntimeError):
    """Another commit has changed what this one replaces."""


def is_snapshot_table(spark: SparkSession, path: str) -> bool:
    return any(n.endswith(".json") for n in child_names(spark, f"{path}/{LOG}"))


def unit_of(partition: str | None, keys: list[str], buckets: int) -> Column:
    """A row's unit; never empty, as a folder's name can't be."""
    if partition:
        return F.coalesce(F.concat(F.lit("p"), F.col(f"`{partition}`").cast("string")), F.lit("none"))
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("string")) if keys else F.lit("all")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each unit and key from the latest commit."""
    by = [UNIT, *keys]
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (COMMIT, *by)]
    return rows.groupBy(*[F.col(f"`{k}`") for k in by]).agg(F.max_by(F.struct(*rest), COMMIT).alias("__row")).select(*[F.col(f"`{k}`") for k in by], "__row.*")


def _keyed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Units and keys under other names, and the condition that rows have the keys of one."""
    out = rows.select(F.col(UNIT).alias("__u"), *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    return out, same


class SnapshotTable:
    """A table at a path; keys, partition and buckets are set by its first commit."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str] = (), partition: str | None = None, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS) -> None:
        self.spark, self.path, self.most_deltas = spark, path.rstrip("/"), most_deltas
        self.first: Snapshot = {"version": -1, "schema": None, "keys": list(keys), "partition": partition, "buckets": buckets, "units": {}, "streams": {}, "tags": {}, "operation": None}

    # Log ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in child_names(self.spark, f"{self.path}/{LOG}") if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version's entry, the newest by default; an empty table's before the first commit."""
        if version is None:
            found = self.versions()
            if not found:
                return self.first
            version = found[-1]
        return json.loads(read_text(self.spark, f"{self.path}/{LOG}/{version:020d}.json"))

    def _folder(self, commit: str) -> str:
        return f"{self.path}/{DATA}/{COMMIT}={commit}"

    def _put(self, entry: Snapshot) -> bool:
        """Makes an entry the newest; False if its number is taken."""
        beside = f"{self.path}/{LOG}/.{uuid.uuid4().hex}"
        write_text(self.spark, beside, json.dumps(entry))
        if rename_new(self.spark, beside, f"{self.path}/{LOG}/{entry['version']:020d}.json"):
            return True
        remove_path(self.spark, beside)
        return False

    def _commit(self, change: Callable[[Snapshot, str | None], Snapshot | None], operation: str, rows: DataFrame | None = None, stream: tuple[str, int] | None = None, sort_by: list[str] | None = None) -> str | None:
        """Writes rows (with their unit) and an entry that change() makes of the newest one and the rows' commit; the commit is name."""
        make_dir(self.spark, f"{self.path}/{LOG}")
        now, name = self.snapshot(), None
        if stream and now["streams"].get(stream[0], -1) >= stream[1]:
            return None
        if rows is not None:
            name = f"{now['version'] + 1:020d}-{uuid.uuid4().hex}"
            rows.hint("rebalance", UNIT).sortWithinPartitions(UNIT, *ordering(sort_by or [])).write.partitionBy(UNIT).parquet(self._folder(name))
        for _ in range(TRIES):
            entry = change(now, name)
            if entry is None:
                return None
            entry = entry | {"version": now["version"] + 1, "operation": operation}
            if stream:
                entry["streams"] = now["streams"] | {stream[0]: stream[1]}
            if self._put(entry):
                return name
            now = self.snapshot()
            if name:  # deltas are ordered by their names, which begin with the version
                new = f"{now['version'] + 1:020d}-{uuid.uuid4().hex}"
                rename_path(self.spark, self._folder(name), self._folder(new))
                name = new
        raise ConflictError(f"{self.path}: no free version number in {TRIES} tries")

    # Reading -----------------------------------------------------------------

    def _files(self, entry: Snapshot, chosen: Iterable[tuple[str, str]]) -> DataFrame:
        """Rows of (commit, unit) folders, with COMMIT, UNIT and DELETED."""
        chosen = sorted(set(chosen))
        schema = StructType.fromJson(entry["schema"]).add(DELETED, "boolean").add(COMMIT, "string").add(UNIT, "string")
        if not chosen:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).option("basePath", f"{self.path}/{DATA}").parquet(*[self._folder(c) for c in sorted({c for c, _ in chosen})])
        return out.where(F.concat_ws("/", COMMIT, UNIT).isin([f"{c}/{u}" for c, u in chosen]))  # a filter of partitions

    def read(self, version: int | None = None, units: set[str] | None = None, with_unit: bool = False, tag: str | None = None) -> DataFrame:
        """The rows of a version or tag, of some units on request."""
        entry = self.snapshot(self.snapshot()["tags"][tag] if tag else version)
        if entry["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no commit")
        names, keys = StructType.fromJson(entry["schema"]).names, entry["keys"]
        columns = [F.col(f"`{c}`") for c in names] + [F.col(UNIT)] * with_unit
        held = {u: x for u, x in entry["units"].items() if units is None or u in units}
        if not keys:
            return self._files(entry, [(c, u) for u, x in held.items() for c in (x["base"], *x["deltas"]) if c]).select(*columns)
        out = self._files(entry, [(x["base"], u) for u, x in held.items() if x["base"] and not x["deltas"]]).select(*columns)
        deltas = [(c, u) for u, x in held.items() for c in x["deltas"]]
        if not deltas:
            return out
        last = _last(self._files(entry, deltas), keys)
        known, same = _keyed(last, keys)
        under = self._files(entry, [(x["base"], u) for u, x in held.items() if x["base"] and x["deltas"]])
        out = out.union(under.join(known, same & (F.col(UNIT) == F.col("__u")), "left_anti").select(*columns))
        return out.union(last.where(~F.coalesce(DELETED, F.lit(False))).select(*columns))

    def exists(self) -> bool:
        return is_snapshot_table(self.spark, self.path)

    # Writing -----------------------------------------------------------------

    def _shaped(self, df: DataFrame, entry: Snapshot) -> tuple[DataFrame, dict]:
        """df with the table's columns and types, new columns last, and the schema with them."""
        known = StructType.fromJson(entry["schema"]) if entry["schema"] else StructType()
        types = {f.name: f.dataType for f in known}
        columns = [(F.col(f"`{n}`").cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()]
        out = df.select(*columns, *[F.col(f"`{c}`") for c in df.columns if c not in types])
        return out, json.loads(out.schema.json())

    def adopt(self) -> None:
        """Makes plain parquet files at the path the first base, once; what a crash left of them goes."""
        plain = [n for n in child_names(self.spark, self.path) if n not in (DATA, LOG)] if path_exists(self.spark, self.path) else []
        if plain and not self.exists() and any(n.endswith(".parquet") or "=" in n for n in plain):
            self.replace_all(self.spark.read.parquet(self.path), "adopt")
        if self.exists():
            for n in plain:
                remove_path(self.spark, f"{self.path}/{n}")

    def units_of(self, df: DataFrame) -> set[str]:
        """The units that rows fall into."""
        return {r[0] for r in self._in_units(df).select(UNIT).distinct().collect()}  # a row a unit

    def _in_units(self, df: DataFrame) -> DataFrame:
        entry = self._layout()
        return df.withColumn(UNIT, unit_of(entry["partition"], entry["keys"], entry["buckets"]))

    def replace_all(self, df: DataFrame, operation: str = "replace_all", stream: tuple[str, int] | None = None) -> str | None:
        """df becomes the table; its columns too."""
        layout = {k: self._layout()[k] for k in ("keys", "partition", "buckets")} | {"schema": json.loads(df.schema.json())}
        return self._commit(lambda now, name: now | layout | {"units": {u: {"base": name, "deltas": []} for u in self._written(name)}}, operation, self._in_units(df), stream)

    def replace_units(self, df: DataFrame, sort_by: list[str] | None = None, stream: tuple[str, int] | None = None) -> str | None:
        """The units that df has rows of have df's rows from now on, the others stay."""
        rows, schema = self._shaped(df, self.snapshot())
        change = lambda now, name: now | {"schema": self._joined(now, schema), "units": now["units"] | {u: {"base": name, "deltas": []} for u in self._written(name)}}
        return self._commit(change, "replace_units", self._in_units(rows), stream, sort_by)

    def upsert(self, df: DataFrame, deleted: str | None = None, moved: bool = False, stream: tuple[str, int] | None = None) -> str | None:
        """df's rows, one for each key, replace the table's rows of their keys; those whose column `deleted` is true remove them.

        moved: a key's old row goes from other units too; that reads the table's keys.
        """
        keys = self._layout()["keys"]
        if not keys:
            raise ValueError("an upsert needs keys")
        if self.exists() and not self.snapshot()["keys"]:
            self.replace_all(self.read(), "set keys")
        flagged = df.withColumn(DELETED, F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False))
        rows, schema = self._shaped(flagged.drop(deleted) if deleted else flagged, self.snapshot())
        schema["fields"] = [f for f in schema["fields"] if f["name"] != DELETED]
        rows = self._in_units(rows)
        if moved and self.exists():
            new, same = _keyed(rows, keys)
            old = self.read(with_unit=True).select(UNIT, *[F.col(f"`{k}`") for k in keys])
            elsewhere = old.join(new, same & (F.col(UNIT) != F.col("__u")), "left_semi")
            # Not from a unit to which the batch brings the key as well.
            gone = elsewhere.join(new, same & (F.col(UNIT) == F.col("__u")), "left_anti")
            rows = rows.unionByName(gone.withColumn(DELETED, F.lit(True)), allowMissingColumns=True)

        def change(now: Snapshot, name: str | None) -> Snapshot:
            units = dict(now["units"])
            for u in self._written(name):
                was = units.get(u)
                if was is None and not deleted and not moved:
                    units[u] = {"base": name, "deltas": []}
                else:
                    was = was or {"base": None, "deltas": []}
                    units[u] = {"base": was["base"], "deltas": [*was["deltas"], name]}
            return now | {"schema": self._joined(now, schema), "units": units}

        name = self._commit(change, "upsert", rows, stream)
        self._compact_full()
        return name

    def insert_new(self, df: DataFrame, stream: tuple[str, int] | None = None) -> str | None:
        """Adds the rows whose keys the table doesn't have yet, one for each key; a feed that is taken again, in whatever run, adds nothing.

        The keys of the units that df falls into are read, nothing else of the table.
        """
        keys = self._layout()["keys"]
        if not keys:
            raise ValueError("new rows are told by keys")
        rows, schema = self._shaped(df.dropDuplicates(keys), self.snapshot())
        rows = self._in_units(rows)
        if self.exists():
            known, same = _keyed(self.read(units=self.units_of(df), with_unit=True), keys)
            rows = rows.join(known, same & (F.col(UNIT) == F.col("__u")), "left_anti")

        def change(now: Snapshot, name: str | None) -> Snapshot | None:
            if now["version"] != seen:
                raise ConflictError(f"{self.path}: another commit came while new rows were told from known ones")
            units = dict(now["units"])
            for u in self._written(name):
                was = units.get(u)
                units[u] = {"base": was["base"], "deltas": [*was["deltas"], name]} if was else {"base": name, "deltas": []}
            return now | {"keys": keys, "schema": self._joined(now, schema), "units": units}

        seen = self.snapshot()["version"]
        name = self._commit(change, "insert_new", rows, stream)
        self._compact_full()
        return name

    def _compact_full(self) -> None:
        """Merges the units that have more deltas than they may; where another commit comes in between, the next one will."""
        full = {u for u, x in self.snapshot()["units"].items() if len(x["deltas"]) > self.most_deltas}
        if full:
            with suppress(ConflictError):
                self.compact(full)

    def compact(self, units: set[str] | None = None) -> str | None:
        """Merges the deltas of units into new bases. Deltas that are committed meanwhile stay on top of them."""
        seen = self.snapshot()
        taken = {u: x for u, x in seen["units"].items() if x["deltas"] and (units is None or u in units)}
        if not taken:
            return None

        def change(now: Snapshot, name: str | None) -> Snapshot:
            made, out = set(self._written(name)), dict(now["units"])
            for u, x in taken.items():
                if out.get(u, {}).get("base") != x["base"] or out[u]["deltas"][: len(x["deltas"])] != x["deltas"]:
                    raise ConflictError(f"{self.path}: {u} was replaced during its compaction")
                out[u] = {"base": name if u in made else None, "deltas": out[u]["deltas"][len(x["deltas"]) :]}
            return now | {"units": {u: x for u, x in out.items() if x["base"] or x["deltas"]}}

        return self._commit(change, "compact", self.read(seen["version"], set(taken), with_unit=True))

    def tag(self, name: str) -> int:
        """Keeps the newest snapshot under a name; its version."""
        self._commit(lambda now, _: now | {"tags": now["tags"] | {name: now["version"]}}, "tag")
        return self.snapshot()["tags"][name]

    def vacuum(self, keep: int = 10) -> int:
        """Removes log entries but the last ones and tagged ones, and folders that none of those left needs; how many folders.

        Only for times without writers or readers of older snapshots: an unfinished commit is folder goes too.
        """
        versions, tags = self.versions(), set(self.snapshot()["tags"].values())
        left = {*versions[-keep:], *tags}
        for v in versions:
            if v not in left:
                remove_path(self.spark, f"{self.path}/{LOG}/{v:020d}.json")
        used = {c for v in left for x in self.snapshot(v)["units"].values() for c in (x["base"], *x["deltas"]) if c}
        gone = [n for n in child_names(self.spark, f"{self.path}/{DATA}") if n.removeprefix(f"{COMMIT}=") not in used]
        for n in gone:
            remove_path(self.spark, f"{self.path}/{DATA}/{n}")
        for n in child_names(self.spark, f"{self.path}/{LOG}"):
            if n.startswith("."):
                remove_path(self.spark, f"{self.path}/{LOG}/{n}")
        return len(gone)

    def committed(self, name: str | None) -> DataFrame:
        """The rows that a commit wrote, those that it removes aside; none for no commit."""
        entry = self.snapshot()
        rows = self._files(entry, [(name, u) for u in self._written(name)] if name else [])
        return rows.where(~F.coalesce(DELETED, F.lit(False))).select(*[F.col(f"`{c}`") for c in StructType.fromJson(entry["schema"]).names])

    def _layout(self) -> Snapshot:
        """The newest snapshot, with keys and a partition if it had none."""
        entry = self.snapshot()
        for what in ("keys", "partition"):
            if self.first[what] and entry[what] and entry[what] != self.first[what]:
                raise ValueError(f"{self.path} has the {what} {entry[what]}, not {self.first[what]}")
        return entry | {"keys": entry["keys"] or self.first["keys"], "partition": entry["partition"] or (None if entry["keys"] else self.first["partition"])}

    def _written(self, name: str | None) -> list[str]:
        """The units that a commit has files of, from its folders' names."""
        return [unquote(n.removeprefix(f"{UNIT}=")) for n in child_names(self.spark, self._folder(name)) if n.startswith(f"{UNIT}=")]

    @staticmethod
    def _joined(now: Snapshot, schema: dict) -> dict:
        """The newest schema with the columns that another one adds."""
        if not now["schema"]:
            return schema
        have = {f["name"] for f in now["schema"]["fields"]}
        return now["schema"] | {"fields": [*now["schema"]["fields"], *(f for f in schema["fields"] if f["name"] not in have)]}


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return SnapshotTable(spark, path).read(version)
