"""Datasets: typed, cleaned and merged tables from declarations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import ordering, predicate, safe_cast, transformed

_HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full", "full": "full", "cross": "cross"}


def _column(df: DataFrame, spec: Mapping[str, Any], source: str):  # noqa: ANN202
    c = F.expr(spec["expression"]) if spec.get("expression") else F.col(source)
    c = transformed(c, spec.get("transform"), spec.get("decimals", 2))
    if spec.get("type"):
        c = safe_cast(df, c, spec["type"], spec.get("default"))
    elif spec.get("default") is not None:
        c = F.coalesce(c, F.lit(spec["default"]))
    return c.alias(spec["name"])


def build_dataset(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """columns {name, source, expression, transform, type, default}, filters on source columns (or `on: output`), order_by."""
    filters = config.get("filters", ())
    for f in filters:
        if f.get("on") != "output":
            df = df.where(predicate(f))
    out = df.select(*[_column(df, c, f"`{c.get('source', c['name'])}`") for c in config["columns"]]) if config.get("columns") else df
    for f in filters:
        if f.get("on") == "output":
            out = out.where(predicate(f))
    return out.orderBy(*ordering(config["order_by"])) if config.get("order_by") else out


def merge_sources(sources: Mapping[str, DataFrame], config: Mapping[str, Any]) -> DataFrame:
    """The first source joined with every further one; columns are picked as {name, source: alias, column}.

    join: {type, on: [{left: "a.x", right: "b.y"}]}; a source may have its own `join`. Joins without
    conditions are errors unless of type cross.
    """
    names = [s["name"] for s in config["sources"]]
    out = sources[names[0]].alias(names[0])
    for spec in config["sources"][1:]:
        join = spec.get("join") or config.get("join", {})
        how = _HOW.get(join.get("type", "left"))
        if how is None:
            raise ValueError(f"unknown join type {join.get('type')!r}")
        right = sources[spec["name"]].alias(spec["name"])
        conditions = [F.col(c["left"]) == F.col(c["right"]) for c in join.get("on", ()) if {c["left"].split(".")[0], c["right"].split(".")[0]} <= set(names[: names.index(spec["name"]) + 1])]
        if how == "cross":
            out = out.crossJoin(right)
        elif not conditions:
            raise ValueError(f"the join with {spec['name']!r} has no conditions")
        else:
            out = out.join(right, reduce(lambda a, b: a & b, conditions), how)
    for f in config.get("filters", ()):
        out = out.where(predicate(f))
    picked = out.select(*[_column(out, c, f"{c['source']}.{c.get('column', c['name'])}") for c in config["columns"]])
    return picked.orderBy(*ordering(config["order_by"])) if config.get("order_by") else picked
