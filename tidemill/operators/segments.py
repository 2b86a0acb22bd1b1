"""Windows over keys with very many rows: a hot key's rows are cut into time ranges that different tasks take.

hot_cuts() finds keys with more than a number of rows, and times that cut them into ranges of about that many.
Inside a range (by, SEG) a window works as over any key. Over ranges, running aggregates go on by what the
ranges before hold together (running()), and frames of the last rows see copies of those rows (with_halo()). Rows
of equal time stay in one range.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import ordering
from tidemill.sources.scratch import stored

SEG, HALO = "__seg", "__halo"
#: Rows of a range, about; and cuts in a table that is broadcast, at most.
SEGMENT_ROWS, FEW_CUTS = 5_000_000, 1_000_000

#: What an aggregate keeps of a range: name, its aggregate, and how those of several ranges are put together.
_KEPT = {
    "count": [("n", F.count, F.sum)],
    "sum": [("s", F.sum, F.sum)],
    "min": [("low", F.min, F.min)],
    "max": [("high", F.max, F.max)],
    "avg": [("n", F.count, F.sum), ("s", lambda v: F.sum(v.cast("double")), F.sum)],
    "stddev": [("n", F.count, F.sum), ("m", F.avg, None), ("q", F.var_pop, None)],
    "last": [("v", None, lambda v: F.last(v, True))],
}


def _same(keys: Iterable[str], to: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"`{k}`").eqNullSafe(F.col(f"`{to}{k}`"))
    return out


def _renamed(df: DataFrame, keys: Iterable[str], to: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{to}{c}" if c in keys else c) for c in df.columns])


def hot_cuts(df: DataFrame, by: str, time: str, rows: int = SEGMENT_ROWS) -> DataFrame | None:
    """Keys with more than `rows` rows and their cuts, times in order; None if there are none. There are at most all rows / `rows` of them."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    sizes = stored(sizes, "hot-keys")
    most, keys = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    if not keys:
        return None
    parts = -(-most // rows)
    hot = df.join(_small(_renamed(sizes.select(by), [by], "__h_"), keys), _same([by], "__h_"), "left_semi")
    at = F.percentile_approx(time, [i / parts for i in range(1, parts)], 100 * parts)
    return stored(hot.groupBy(by).agg(F.array_sort(F.array_distinct(at)).alias("__cuts")), "hot-cuts")


def _small(df: DataFrame, cuts: int) -> DataFrame:
    return F.broadcast(df) if cuts <= FEW_CUTS else df


def parted(df: DataFrame, by: str, time: str, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of other keys, and those of hot keys with SEG, the number of their range; null times come last."""
    known = _small(_renamed(cuts, [by], "__h_"), cuts.agg(F.coalesce(F.sum(F.size("__cuts") + 1), F.lit(0))).first()[0])
    cold = df.join(known, _same([by], "__h_"), "left_anti")
    t = F.col(f"`{time}`")
    seg = F.when(t.isNull(), F.size("__cuts")).otherwise(F.size(F.filter("__cuts", lambda c: c <= t)))
    return cold, df.join(known, _same([by], "__h_")).withColumn(SEG, seg).drop(f"__h_{by}", "__cuts")


def running(df: DataFrame, by: list[str], order_by: list[str], aggs: list[tuple[str, str, Column]], own: bool) -> DataFrame:
    """df (with SEG) with running aggregates (name, kind, value) of its key's rows before it, and its own with `own`.

    One shuffle by (by, SEG); a row for each key and range is carried on to the next ranges.
    """
    df = df.withColumns({f"__v{i}": v for i, (_, _, v) in enumerate(aggs)})
    w = Window.partitionBy(*by, SEG).orderBy(*ordering(order_by)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    earlier = Window.partitionBy(*by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct(*[F.struct(F.col(f"`{o}`").isNull().alias("none"), F.col(f"`{o}`").alias("o")) for o in order_by])
    here, whole, carried = {}, [], {}
    for i, (_, kind, _) in enumerate(aggs):
        v = F.col(f"__v{i}")
        for name, agg, join in _KEPT[kind]:
            at = f"{name}{i}"
            here[f"__here_{at}"] = F.last(v, True).over(w) if kind == "last" else agg(v).over(w)
            whole.append((F.max_by(v, F.when(v.isNotNull(), order)) if kind == "last" else agg(v)).alias(f"__whole_{at}"))
            if join:
                carried[f"__all_{at}"] = join(F.col(f"__whole_{at}")).over(earlier)
        if kind == "stddev":  # counts, means and variances of all ranges before together
            n, m, q = (F.col(f"__whole_{x}{i}") for x in "nmq")
            total, mean = F.sum(n).over(earlier), F.sum(n * m).over(earlier) / F.sum(n).over(earlier)
            carried |= {f"__all_m{i}": mean, f"__all_q{i}": F.sum(F.coalesce(n * (q + m * m), F.lit(0.0))).over(earlier) / total - mean * mean}
    before = df.groupBy(*by, SEG).agg(*whole).select(*by, SEG, *[c.alias(n) for n, c in carried.items()])
    out = df.withColumns(here).join(_renamed(before, [*by, SEG], "__b_"), _same([*by, SEG], "__b_"))
    plus = lambda a, b: F.coalesce(a + b, a, b)
    made = {}
    for i, (name, kind, _) in enumerate(aggs):
        part = lambda x: (F.col(f"__all_{x}{i}"), F.col(f"__here_{x}{i}"))  # noqa: B023, E731
        if kind == "count":
            made[name] = F.coalesce(plus(*part("n")), F.lit(0))
        elif kind == "sum":
            made[name] = plus(*part("s"))
        elif kind in ("min", "max"):
            made[name] = (F.least if kind == "min" else F.greatest)(*part("low" if kind == "min" else "high"))
        elif kind == "avg":
            n = F.coalesce(plus(*part("n")), F.lit(0))
            made[name] = F.when(n > 0, plus(*part("s")) / n)
        elif kind == "last":
            made[name] = F.coalesce(F.col(f"__here_v{i}"), F.col(f"__all_v{i}"))
        else:
            (n1, n2), (m1, m2), (q1, q2) = ((F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))) for a, b in (part("n"), part("m"), part("q")))
            n = n1 + n2
            made[name] = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), n1 * q1 + n2 * q2 + (m1 - m2) * (m1 - m2) * n1 * n2 / n) / (n - 1)))
    return out.withColumns(made).select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__v")], *made)


def with_halo(df: DataFrame, by: list[str], order_by: list[str], n: int) -> DataFrame:
    """df (with SEG) and, with HALO true, copies of the n rows of each key that stand before each of its ranges, in that range."""
    sizes = df.groupBy(*by, SEG).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, F.struct(F.col(SEG).alias("seg"), before.alias("before")).alias("__s")).groupBy(*by).agg(F.collect_list("__s").alias("__starts"))
    placed = df.withColumn("__pos", F.row_number().over(Window.partitionBy(*by, SEG).orderBy(*ordering(order_by))))
    placed = placed.join(_renamed(starts, by, "__b_"), _same(by, "__b_"))
    at = F.col("__pos") + F.get(F.filter("__starts", lambda s: s["seg"] == F.col(SEG)), F.lit(0))["before"]
    later = F.filter("__starts", lambda s: (s["seg"] > F.col(SEG)) & (s["before"] - F.col("__at") < n))
    near = placed.withColumn("__at", at).select(*df.columns, F.explode(later).alias("__to")).withColumn(SEG, F.col("__to.seg")).drop("__to")
    return df.withColumn(HALO, F.lit(False)).unionByName(near.withColumn(HALO, F.lit(True)))
