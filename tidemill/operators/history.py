"""Entity-history features that never see the row itself or later ones, in one or several passes."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.operators import segments

_AGGS = {"count": F.count, "avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "stddev": F.stddev_samp}


@dataclass(frozen=True)
class Part:
    """A look-back column: an aggregate, or lag, of a value over rows before this one of the entity and `by`; the last `back` of them, or all. Or a column of other windows."""

    name: str
    agg: str = ""
    value: Column | None = None
    by: tuple[str, ...] = ()
    back: int | None = None
    then: Callable[[Column], Column] = field(default=lambda c: c)
    column: Column | None = None


class History:
    """Look-back features of an entity over time; `tiebreak` makes the order of equal times definite.

    Entities of more than segment_rows rows are cut into time ranges, so that no task takes a whole one; None
    leaves that out, and with it the count of each entity's rows.
    """

    def __init__(self, entity: str, time: str, tiebreak: list[str], segment_rows: int | None = segments.SEGMENT_ROWS) -> None:
        self.entity, self.time, self.tiebreak, self.segment_rows = entity, time, tiebreak, segment_rows

    def spec(self, by: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> WindowSpec:
        order = [F.col(self.time).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in self.tiebreak]]
        return Window.partitionBy(self.entity, *by, *more).orderBy(*order)

    @staticmethod
    def back(window: str) -> int | None:
        """Rows of a frame: None of all_time, N of last_N."""
        if window == "all_time":
            return None
        if m := re.fullmatch(r"last_(\d+)", window):
            return int(m[1])
        raise ValueError(f"unknown window {window!r}")

    def parts(self, f: Mapping[str, Any]) -> list[list[Part]]:
        """The feature's columns, in steps; a later step may use an earlier one's."""
        kind, name, by = f["type"], f["name"], tuple(f.get("partition_by") or ())
        kind = {"average": "avg"}.get(kind, kind)
        if kind in _AGGS:
            windows = f.get("windows") or [f.get("window", "all_time")]
            keep = F.expr(f["filter"]) if f.get("filter") else None
            value = F.lit(1) if kind == "count" else F.expr(f["expression"])
            value = F.when(keep, value) if keep is not None else value
            return [[Part(name if len(windows) == 1 else f"{name}_{w}", kind, value, by, self.back(w)) for w in windows]]
        if kind == "time_since_last_event":
            t = F.unix_micros(F.col(self.time).cast("timestamp"))
            return [[Part(name, "lag", t, by, 1, lambda last: (t - last) / F.lit(86_400_000_000.0))]]
        if kind == "is_first_time":
            return [[Part(name, "count", F.lit(1), (*by, *f["context"]), None, lambda n: n == 0)]]
        if kind == "diff_from_last":
            v = F.expr(f["expression"])
            return [[Part(name, "lag", v, by, 1, lambda last: v - last)]]
        if kind == "contextual_delta_from_min":
            v = F.expr(f["expression"])
            low = F.when(F.expr(f["filter"]), v) if f.get("filter") else v
            delta = v - F.min(low).over(Window.partitionBy(*f["context"]))
            if not f.get("lagged"):
                return [[Part(name, column=delta)]]
            return [[Part(f"__{name}", column=delta)], [Part(name, "lag", F.col(f"__{name}"), by, 1)]]
        if kind == "derived":
            return [[Part(name, column=F.expr(f["expression"]))]]
        raise ValueError(f"unknown feature type {kind!r}")

    def column(self, p: Part, more: tuple[str, ...] = ()) -> Column:
        if p.column is not None:
            return p.column
        w = self.spec(p.by, more)
        if p.agg == "lag":
            return p.then(F.lag(p.value, p.back).over(w))
        return p.then(_AGGS[p.agg](p.value).over(w.rowsBetween(Window.unboundedPreceding if p.back is None else -p.back, -1)))

    def added(self, df: DataFrame, parts: list[Part], cuts: DataFrame | None) -> DataFrame:
        """df with the columns of one step; hot entities' by ranges."""
        plain = {p.name: p.column for p in parts if p.column is not None}
        df = df.withColumns(plain) if plain else df
        parts = [p for p in parts if p.column is None]
        if cuts is None or not parts:
            return df.withColumns({p.name: self.column(p) for p in parts}) if parts else df
        cold, hot = segments.parted(df, self.entity, self.time, cuts)
        for by in dict.fromkeys(p.by for p in parts):
            keys, order = [self.entity, *by], [self.time, *self.tiebreak]
            whole = [p for p in parts if p.by == by and p.back is None]
            if whole:
                made = segments.running(hot, keys, order, [(f"__p{i}", p.agg, p.value) for i, p in enumerate(whole)], own=False)
                hot = made.withColumns({p.name: p.then(F.col(f"__p{i}")) for i, p in enumerate(whole)}).drop(*[f"__p{i}" for i in range(len(whole))])
            near = [p for p in parts if p.by == by and p.back is not None]
            if near:
                seen = segments.with_halo(hot, keys, order, max(p.back for p in near))
                seen = seen.withColumns({p.name: self.column(p, (segments.SEG,)) for p in near})
                hot = seen.where(~F.col(segments.HALO)).drop(segments.HALO)
        cold = cold.withColumns({p.name: self.column(p) for p in parts})
        return cold.unionByName(hot.drop(segments.SEG))

    def one_pass(self, df: DataFrame, features: list[Mapping[str, Any]], cuts: DataFrame | None = None) -> DataFrame:
        """Look-back features of a pass see the input columns; its derived ones see all before them."""
        steps = [self.parts(f) for f in features if f["type"] != "derived"]
        for i in range(max((len(s) for s in steps), default=0)):
            df = self.added(df, [p for s in steps if i < len(s) for p in s[i]], cuts)
        for f in features:
            if f["type"] == "derived":
                df = df.withColumns({p.name: p.column for p in self.parts(f)[0]})
        return df.drop(*[f"__{f['name']}" for f in features if f.get("lagged")])

    def build(self, df: DataFrame, passes: list[list[Mapping[str, Any]]], predicate: str | None = None, post_predicate: str | None = None) -> DataFrame:
        """predicate removes rows before any window sees them, post_predicate from the result only."""
        df = df.where(predicate) if predicate else df
        cuts = segments.hot_cuts(df, self.entity, self.time, self.segment_rows) if self.segment_rows else None
        for features in passes:
            df = self.one_pass(df, features, cuts)
        return df.where(post_predicate) if post_predicate else df
