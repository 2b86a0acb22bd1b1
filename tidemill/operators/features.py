"""Feature sets: expressions, windows, aggregates, staged filters and quality rules."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import ordering, predicate, quality_condition, transformed

_RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
_AGGS = {
    "avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp,
    "stddev_pop": F.stddev_pop, "variance": F.var_samp, "median": F.median, "first": F.first, "last": F.last,
}


def aggregate(function: str, column: str | None = None) -> Column:
    """COUNT(*) or function(column)."""
    name = function.lower()
    if name == "count" and (column in (None, "*")):
        return F.count(F.lit(1))
    if name == "count_distinct":
        return F.count_distinct(F.expr(column))
    if name not in _AGGS:
        raise ValueError(f"unknown aggregate {function!r}")
    return _AGGS[name](F.expr(column))


def window_feature(spec: Mapping[str, Any]) -> Column:
    """{function, column, partition_by, order_by, n} over the default frame; ranks are bigint and need order_by."""
    w = Window.partitionBy(*spec["partition_by"]) if spec.get("partition_by") else None
    if w is None:
        raise ValueError("a window without partition_by puts all rows in one task; use global_rank")
    if spec.get("order_by"):
        w = w.orderBy(*ordering(spec["order_by"]))
    f = spec["function"].lower()
    if f in _RANKS or f == "ntile":
        if not spec.get("order_by"):
            raise ValueError(f"{f} needs order_by")
        if f == "ntile":
            return F.ntile(spec["n"]).over(w).cast("bigint")
        out = _RANKS[f]().over(w)
        return out if f in ("percent_rank", "cume_dist") else out.cast("bigint")
    return aggregate(f, spec.get("column")).over(w)


def expression_features(df: DataFrame, features: list[Mapping[str, Any]], keep: bool = True) -> DataFrame:
    """Features in order; each may use those before it. {name, expression | source, transform, decimals}."""
    for f in features:
        if f.get("expression"):
            c = F.expr(f["expression"])
        elif f.get("source"):
            c = F.col(f["source"])
        else:
            c = F.lit(None).cast(f.get("type", "string"))
        df = df.withColumn(f["name"], transformed(c, f.get("transform"), f.get("decimals", 2)))
    return df if keep else df.select(*[f["name"] for f in features])


def apply_quality(df: DataFrame, rules: list[Mapping[str, Any]]) -> DataFrame:
    """Drops rows that fail a rule; `unique` keeps the first row of each key by order_by."""
    for r in rules:
        if r["type"] == "unique":
            keys = r.get("columns") or [r["column"]]
            w = Window.partitionBy(*keys).orderBy(*ordering(r["order_by"]))
            df = df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
        else:
            df = df.where(quality_condition(r))
    return df


def build_features(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """source_filters, quality_rules, features, window_features, aggregations, final_filters (or filters), order_by, limit.

    aggregations: {group_by, metrics: [{name, function, column}], mode: replace | join_back}.
    """
    for f in config.get("source_filters", ()):
        df = df.where(predicate(f))
    df = apply_quality(df, config.get("quality_rules", []))
    out = expression_features(df, config.get("features", []), config.get("include_source_columns", True))
    windows = config.get("window_features", ())
    for w in sorted(windows, key=lambda w: (w.get("partition_by") or [], str(w.get("order_by")))):  # equal windows next to each other share a sort
        out = out.withColumn(w["name"], window_feature(w))
    if agg := config.get("aggregations"):
        metrics = [aggregate(m["function"], m.get("column")).alias(m["name"]) for m in agg["metrics"]]
        grouped = out.groupBy(*agg["group_by"]).agg(*metrics) if agg.get("group_by") else out.agg(*metrics)
        if agg.get("mode") == "join_back":
            keys = agg["group_by"]
            right = grouped.select(*[F.col(k).alias(f"__{k}") for k in keys], *[m["name"] for m in agg["metrics"]])
            cond = None
            for k in keys:
                e = out[k].eqNullSafe(right[f"__{k}"])
                cond = e if cond is None else cond & e
            out = out.join(right, cond, "left").drop(*[f"__{k}" for k in keys])
        else:
            out = grouped
    for f in [*config.get("final_filters", ()), *config.get("filters", ())]:
        out = out.where(predicate(f))
    if config.get("order_by"):
        out = out.orderBy(*ordering(config["order_by"]))
    return out.limit(config["limit"]) if config.get("limit") else out
