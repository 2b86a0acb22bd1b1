"""Column expressions: safe casts, transforms, predicates, quality rules, scalar helpers.

Semantics that differ between SQL engines are settled here once: text to integer rounds half away
from zero, floating point to integer rounds half to even, DECIMAL is (18, 3), division by zero is
null, NULL sorts last.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CASTS = {
    "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float", "DECIMAL": "decimal(18,3)",
    "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
}
NULL_MARKERS = ("NaN", "nan", "null", "NULL", "None", "")


def type_of(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("c")).schema[0].dataType


def safe_cast(df: DataFrame, c: Column, target: str, default: Any = None) -> Column:
    """c as the target type, null or the default where that fails; unknown types become strings."""
    to = _CASTS.get(target.upper())
    if to is None:
        out = c.cast("string")
        return out if default is None else F.coalesce(out, F.lit(str(default)))
    if default is not None and to in ("float", "decimal(18,3)"):
        to = "double"  # a default makes these double
    kind = type_of(df, c)
    if to in ("int", "bigint"):
        if isinstance(kind, T.StringType):
            c = F.round(c.try_cast("double"))
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.bround(c)
    out = c.try_cast(to)
    return out if default is None else F.coalesce(out, F.lit(default).cast(to))


def transformed(c: Column, how: str | None, decimals: int = 2) -> Column:
    """trim, upper, lower, abs or round of c."""
    if not how:
        return c
    known = {"trim": F.trim, "upper": F.upper, "lower": F.lower, "abs": F.abs, "round": lambda x: F.round(x, decimals)}
    if how not in known:
        raise ValueError(f"unknown transform {how!r}")
    return known[how](c)


def predicate(spec: Mapping[str, Any]) -> Column:
    """A filter {column, operator, value, allow_null} as a Column."""
    c, op, v = F.col(spec["column"]), str(spec.get("operator", "=")).lower(), spec.get("value")
    table = {
        "=": lambda: c == F.lit(v), "==": lambda: c == F.lit(v), "!=": lambda: c != F.lit(v), "<>": lambda: c != F.lit(v),
        "<": lambda: c < F.lit(v), "<=": lambda: c <= F.lit(v), ">": lambda: c > F.lit(v), ">=": lambda: c >= F.lit(v),
        "is_null": c.isNull, "is_not_null": c.isNotNull, "not_empty": lambda: c.isNotNull() & (c != ""),
        "in": lambda: c.isin(list(v)), "not_in": lambda: ~c.isin(list(v)), "like": lambda: c.like(v), "between": lambda: c.between(F.lit(v[0]), F.lit(v[1])),
    }
    if op not in table:
        raise ValueError(f"unknown filter operator {op!r}")
    out = table[op]()
    return out | c.isNull() if spec.get("allow_null") else out


def quality_condition(rule: Mapping[str, Any]) -> Column:
    """What a row must meet under a quality rule not_null, not_empty, range, in_list, regex or custom."""
    kind = rule["type"]
    c = F.col(rule["column"]) if "column" in rule else None
    if kind == "not_null":
        return c.isNotNull()
    if kind == "not_empty":
        return c.isNotNull() & (c.cast("string") != "")
    if kind == "range":
        x = c.try_cast("double") if rule.get("cast") == "numeric" else c
        both = [x >= F.lit(rule["min"])] if rule.get("min") is not None else []
        both += [x <= F.lit(rule["max"])] if rule.get("max") is not None else []
        if not both:
            raise ValueError("a range rule needs min or max")
        return both[0] if len(both) == 1 else both[0] & both[1]
    if kind == "in_list":
        return c.isin(list(rule["values"]))
    if kind == "regex":
        return c.rlike(rule["pattern"])
    if kind == "custom":
        return F.expr(rule["expression"])
    raise ValueError(f"unknown quality rule {kind!r}")


def null_markers(df: DataFrame, markers: Iterable[str] = NULL_MARKERS) -> DataFrame:
    """Texts that stand for null, and NaN in numbers, as null."""
    gone = list(markers)
    kinds = {f.name: f.dataType for f in df.schema}

    def clean(n: str) -> Column:
        if isinstance(kinds[n], T.StringType):
            return F.when(~F.col(n).isin(gone), F.col(n))
        if isinstance(kinds[n], (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(n), F.col(n))
        return F.col(n)

    return df.select(*[clean(n).alias(n) for n in df.columns])


def auto_numeric(df: DataFrame, share: float = 0.5) -> DataFrame:
    """String columns of which more than that share of all rows are numbers become doubles; one pass counts all columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(n).try_cast("double")).alias(f"n{i}") for i, n in enumerate(texts)]).first()
    numeric = {n for i, n in enumerate(texts) if counts[f"n{i}"] > share * counts["rows"]}
    return df.select(*[F.col(n).try_cast("double").alias(n) if n in numeric else F.col(n) for n in df.columns])


def one_hot(column: str, values: Iterable[Any], prefix: str | None = None) -> dict[str, Column]:
    """A 0/1 column for each value, null where the column is null."""
    return {f"{prefix or column}_{v}": (F.col(column) == F.lit(v)).cast("int") for v in values}


def binned(column: str, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that the value is below; the last label above all edges."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    out = F.when(F.col(column).isNull(), F.lit(None).cast("string"))
    for e, n in zip(edges, labels, strict=False):
        out = out.when(F.col(column) < e, n)
    return out.otherwise(labels[-1])


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def joined_text(*cs: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *cs)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def ordering(spec: str | Iterable[str]) -> list[Column]:
    """Sort columns from texts like "a" or "b DESC"; nulls last either way."""
    out = []
    for s in [spec] if isinstance(spec, str) else spec:
        name, _, way = s.strip().partition(" ")
        out.append(F.col(name).desc_nulls_last() if way.strip().upper() == "DESC" else F.col(name).asc_nulls_last())
    return out


def partition_segment(c: Column) -> Column:
    """A safe directory name: null, blank and unusual characters stay apart."""
    t = c.cast("string")
    return F.when(t.isNull(), "__null__").when(F.trim(t) == "", "__empty__").otherwise(F.regexp_replace(t, "[^A-Za-z0-9._-]", "_"))


def param_value(value: Any, kind: str) -> Any:
    """A parameter's value in its declared type."""
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return [param_value(v, kind) for v in value]
    kind = kind.lower()
    if kind in ("int", "integer"):
        return int(value)
    if kind in ("float", "double", "number"):
        return float(value)
    if kind in ("bool", "boolean"):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "y")
    if kind == "json":
        import json

        return json.loads(value) if isinstance(value, str) else value
    if kind in ("date", "datetime", "timestamp", "string", "raw"):
        return str(value)
    raise ValueError(f"unknown parameter type {kind!r}")


def _literal(v: Any) -> str:
    """A value as SQL text."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def param_filters(filters: Iterable[Mapping[str, Any]], params: Mapping[str, Any], where: str | None = None, required: Iterable[str] = ()) -> tuple[Column, dict[str, Any]]:
    """The condition of parameterised filters, and the parameters that it used.

    A filter has column, operator, param, aliases, type, default, required, include_if_missing. where
    is a template with {param} places; values go in as literals, never as text.
    """
    used: dict[str, Any] = {}
    parts: list[Column] = []
    for f in filters:
        name = next((n for n in [f.get("param", f["column"]), *f.get("aliases", ())] if n in params), None)
        raw = params[name] if name else f.get("default")
        if name is None and raw is None and "default" not in f:
            if f.get("required"):
                raise ValueError(f"parameter {f.get('param', f['column'])!r} is required")
            if not f.get("include_if_missing"):
                continue
        v, op, c = param_value(raw, f.get("type", "string")), str(f.get("operator", "=")).upper(), F.col(f["column"])
        used[f.get("param", f["column"])] = v
        if f.get("type") in ("date", "timestamp", "datetime") and v is not None:
            cast = "date" if f["type"] == "date" else "timestamp"
            lit = lambda x, cast=cast: F.lit(x).cast(cast)
        else:
            lit = F.lit
        if op in ("IS NULL", "IS NOT NULL"):
            parts.append(c.isNull() if op == "IS NULL" else c.isNotNull())
        elif v is None:
            parts.append(c.isNotNull() if op in ("!=", "<>") else c.isNull())
        elif op in ("IN", "NOT IN"):
            inside = c.isin([lit(x) for x in v])
            parts.append(inside if op == "IN" else ~inside)
        elif op == "BETWEEN":
            parts.append(c.between(lit(v[0]), lit(v[1])))
        else:
            plain = {"=": c == lit(v), "!=": c != lit(v), "<>": c != lit(v), "<": c < lit(v), "<=": c <= lit(v), ">": c > lit(v), ">=": c >= lit(v)}
            if op not in plain:
                raise ValueError(f"unknown filter operator {op!r}")
            parts.append(plain[op])
    if missing := [p for p in required if p not in params]:
        raise ValueError(f"parameters are required: {', '.join(missing)}")
    if where:
        # One pass over the template, so that a value is never looked into for places.
        places = "|".join(re.escape("{" + n + "}") for n in sorted(params, key=len, reverse=True))

        def filled(m: re.Match) -> str:
            name = m[0][1:-1]
            used[name] = params[name]
            return _literal(params[name])

        where = re.sub(places, filled, where) if params else where
        parts.append(F.expr(where))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out, used
