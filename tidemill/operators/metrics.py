"""Evaluation as aggregates: classification, regression, binary, grouped; medians and modes; splits."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.exprs import ordering
from tidemill.operators.rank import global_rank, key_positions

TINY = 1e-15


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, actual: str, predicted: str, positive: Any = 1) -> DataFrame:
    """One row: accuracy, precision, recall, f1 (of the positive class for up to two classes, else weighted by support)."""
    cells = confusion(df, actual, predicted)
    sides = cells.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).alias("found"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(F.col("predicted").alias("label"), F.lit(0).alias("support"), F.col("n").alias("found"), F.lit(0).alias("hit")))
    by = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("found").alias("found"), F.sum("hit").alias("hit"))
    by = by.withColumns({"p": F.coalesce(F.try_divide(F.col("hit"), F.col("found")), F.lit(0.0)), "r": F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))})
    by = by.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    one = lambda c: F.coalesce(F.max(F.when(F.col("label") == F.lit(positive), F.col(c))), F.lit(0.0))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    pick = lambda c: F.when(F.count(F.lit(1)) <= 2, one(c)).otherwise(weighted(c))
    return by.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), pick("p").alias("precision"), pick("r").alias("recall"), pick("f").alias("f1"))


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mse, rmse, mae, r2."""
    a, d = F.col(actual), F.col(actual) - F.col(predicted)
    mse = F.avg(d * d)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.try_divide(mse, F.var_pop(a))).alias("r2"))


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))


def log_loss(label: str, p: str) -> Column:
    c = clipped(F.col(p))
    return F.avg(F.when(F.col(label) == 1, -F.log(c)).otherwise(-F.log(1 - c)))


def binary(df: DataFrame, label: str, p: str) -> DataFrame:
    """One row: log_loss, brier; rows of NaN or null scores are dropped."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    return rows.agg(log_loss(label, p).alias("log_loss"), F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"))


def auc(df: DataFrame, label: str, p: str) -> DataFrame:
    """One row: the area under the ROC curve from rank sums of distinct scores, so ties count half."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p)).select(F.col(p).alias("score"), F.col(label).cast("int").alias("label"))
    places = key_positions(rows.select("score"), ["score"]).select(F.col("score").alias("s"), (F.col("before") + (F.col("n") + 1) / 2).alias("mid"))
    met = rows.groupBy("score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).join(places, F.col("score") == F.col("s"))
    pos, n = F.sum("pos"), F.sum("n")
    return met.agg(F.try_divide(F.sum(F.col("pos") * F.col("mid")) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def group_softmax(df: DataFrame, group: str, score: str, name: str = "p") -> DataFrame:
    w = Window.partitionBy(group)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("__e", e).withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def top1(df: DataFrame, group: str, score: str, tiebreak: list[str]) -> DataFrame:
    """The row of the highest score of each group; the first by the tiebreak columns among equals. No sort: partial aggregation."""
    low = F.struct((-F.col(score)).alias("__s"), *tiebreak)
    return df.groupBy(F.col(group).alias("__g")).agg(F.min_by(F.struct(*df.columns), low).alias("__r")).select("__r.*")


def group_metrics(df: DataFrame, group: str, label: str, p: str, tiebreak: list[str]) -> DataFrame:
    """One row over groups with exactly one winner: groups, top1_accuracy, log_loss of the winner's probability."""
    good = df.groupBy(F.col(group).alias("__g")).agg(F.sum(label).alias("__w")).where("__w = 1").select("__g")
    rows = df.join(good, df[group] == good["__g"], "left_semi")
    best = top1(rows, group, p, tiebreak).agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col(label).cast("double")).alias("top1_accuracy"))
    loss = rows.where(F.col(label) == 1).agg(F.avg(-F.log(clipped(F.col(p)))).alias("log_loss"))
    return best.crossJoin(loss)  # two single rows


#: Bars of a step of medians(), and distinct values of a bar that are taken to the driver.
BARS, FEW_VALUES = 1024, 2048


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Medians of numeric columns: the mean of the one or two middle values; nulls and NaN aside. All columns together, in a few passes.

    A pass counts each column's values in bars of the range that is left, BARS of them, and keeps the bar or bars of
    the middle values; once these hold few values, or one, the values themselves are counted.
    """
    v = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    r = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(v[c]).alias(f"n{i}"), F.min(v[c]).alias(f"a{i}"), F.max(v[c]).alias(f"z{i}"))]).first()
    # For each column: rows below the range, the range, and the ranks of the middle values.
    left = {c: [0, r[f"a{i}"], r[f"z{i}"], ((r[f"n{i}"] - 1) // 2, r[f"n{i}"] // 2), r[f"n{i}"]] for i, c in enumerate(columns) if r[f"n{i}"]}
    out: dict[str, float | None] = dict.fromkeys(columns)

    def melted(kind: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("c"), v[c].alias("v"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for c, (_, low, high, _, _) in left.items()])
        each = df.select(F.explode(rows).alias("x")).select("x.*").where("v between low and high")
        return each.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")) if kind == "values" else each

    while left:
        done = [c for c, (_, low, high, _, _) in left.items() if low == high]
        for c in done:
            out[c] = float(left.pop(c)[1])
        few = {c: x for c, x in left.items() if x[4] <= FEW_VALUES}
        if few and len(few) == len(left):
            held: dict[str, list] = {}
            for x in melted("values").collect():  # FEW_VALUES a column at most
                held.setdefault(x["c"], []).append((x["v"], x["n"]))
            for c, (below, _, _, ranks, _) in left.items():
                found, at = [], below
                for value, n in sorted(held[c]):
                    found += [value for k in ranks if at <= k < at + n]
                    at += n
                out[c] = float(sum(found) / 2)
            break
        if not left:
            break
        bar = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BARS), F.lit(BARS - 1))
        held = {}
        for x in melted("bars").groupBy("c", bar.alias("bar")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():  # BARS a column at most
            held.setdefault(x["c"], []).append((x["low"], x["high"], x["n"]))
        for c, x in left.items():
            at, kept = x[0], []
            for low, high, n in sorted(held[c]):
                if any(at <= k < at + n for k in x[3]):
                    kept.append((at, low, high, n))
                at += n
            x[0], x[1], x[2], x[4] = kept[0][0], kept[0][1], kept[-1][2], sum(k[3] for k in kept)
            if len(kept) == 2:  # the middle values end one bar and begin the next, whatever lies in between
                out[c] = (kept[0][2] + kept[1][1]) / 2
        for c in [c for c in left if out[c] is not None]:
            left.pop(c)
    return out


def modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """The most frequent value of each column, the smallest on ties; nulls aside. One aggregation of counted values for all columns, so no task holds a column's values."""
    kinds = {f.name: f.dataType for f in df.schema}
    groups: dict[Any, list[str]] = {}
    for c in columns:
        groups.setdefault(kinds[c].simpleString(), []).append(c)
    out = dict.fromkeys(columns)
    for same in groups.values():  # one for each type of column
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in same])).alias("x")).select("x.*").where("v is not null")
        counted = rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counted.groupBy("c").agg(F.max("n").alias("top")).withColumnRenamed("c", "k")
        best_ = counted.join(F.broadcast(top), (F.col("c") == F.col("k")) & (F.col("n") == F.col("top"))).groupBy("c").agg(F.min("v").alias("v"))
        out |= {r["c"]: r["v"] for r in best_.collect()}  # a row a column
    return out


def impute_stats(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, Any]:
    """Medians of numeric columns, the most frequent value of others."""
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    out = modes(df, [c for c in columns if c not in numeric])
    if approximate and numeric:
        return out | df.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in numeric]).first().asDict()
    return out | medians(df, numeric)


def impute(df: DataFrame, stats: dict[str, Any]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in stats.items() if v is not None})


def hash_share(keys: list[str], seed: int) -> Column:
    """A repeatable number in 0..9999 for a row's key."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10000


def split_random(df: DataFrame, keys: list[str], test_size: float, seed: int = 42) -> DataFrame:
    """Adds is_test by a hash of the row's key (or of the group's, for a group split)."""
    return df.withColumn("is_test", hash_share(keys, seed) < int(round(test_size * 10000)))


def split_time(df: DataFrame, time: str, cutoff: str | None = None, test_size: float | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """Adds is_test: at or after the cutoff, or the last share of rows in order of time and tiebreak (unique together)."""
    if cutoff is not None:
        return df.withColumn("is_test", F.col(time) >= F.lit(cutoff).cast("timestamp"))
    ranked = global_rank(df, [time, *(tiebreak or [])], total=True)
    # Decimals, as 90,000 * (1 - 0.3) in doubles is below 63,000.
    return ranked.withColumn("is_test", F.col("rank") > F.floor(F.col("total_rows") * F.lit(1 - Decimal(str(test_size))))).drop("rank", "dense_rank", "percent_rank", "cume_dist", "total_rows")


def split_group_time(df: DataFrame, group: str, time: str, test_size: float) -> DataFrame:
    """Adds is_test to whole groups: the last share of groups by their first time, then by group."""
    groups = df.groupBy(group).agg(F.min(time).alias("first_time"))
    marked = split_time(groups, "first_time", test_size=test_size, tiebreak=[group]).select(F.col(group).alias("__g"), "is_test")
    return df.join(marked, df[group] == marked["__g"]).drop("__g")


def best(df: DataFrame, metric: str, higher: bool = True, tiebreak: str = "name") -> DataFrame:
    """The row with the best metric."""
    return df.where(F.col(metric).isNotNull()).orderBy(*ordering([f"{metric} DESC" if higher else metric, tiebreak])).limit(1)
