"""Ranks over a whole table without one task for all rows.

Distinct sort keys are counted, dealt out by ranges and summed within each range; the few range
totals become offsets. Every row then looks its key up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import ordering
from tidemill.sources.scratch import stored


def key_positions(df: DataFrame, order_by: list[str], partitions: int | None = None) -> DataFrame:
    """The distinct sort keys with n (rows), before (rows of smaller keys), place (smaller keys) and total (all rows)."""
    keys = [o.split()[0] for o in order_by]
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(partitions, *ordering(order_by)).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged.sortWithinPartitions(*ordering(order_by)), "rank-keys")
    # A row for each range, so at most `partitions` rows: they become a small table of offsets.
    parts, offsets, total, distinct = ranged.groupBy("part").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys")).collect(), [], 0, 0
    for r in sorted(parts):
        offsets.append((r["part"], total, distinct))
        total, distinct = total + r["rows"], distinct + r["keys"]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "part int, rows_before bigint, keys_before bigint"))
    own = Window.partitionBy("part").orderBy(*ordering(order_by))
    before = F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + F.col("rows_before")
    place = F.row_number().over(own) - 1 + F.col("keys_before")
    return ranged.join(starts, "part").select(*keys, "n", before.cast("bigint").alias("before"), place.cast("bigint").alias("place"), F.lit(total).cast("bigint").alias("total"))


def global_rank(df: DataFrame, order_by: list[str], total: bool = False) -> DataFrame:
    """df with rank, dense_rank, percent_rank and cume_dist over all rows, and their number on request; with a unique order, rank is the row number."""
    keys = [o.split()[0] for o in order_by]
    places = key_positions(df, order_by).select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "before", "place", "total")
    same = None
    for k in keys:
        e = df[k].eqNullSafe(places[f"__{k}"])
        same = e if same is None else same & e
    share = F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0)
    return df.join(places, same).select(
        *[df[c] for c in df.columns], (F.col("before") + 1).alias("rank"), (F.col("place") + 1).alias("dense_rank"),
        share.alias("percent_rank"), ((F.col("before") + F.col("n")) / F.col("total")).alias("cume_dist"), *([F.col("total").alias("total_rows")] if total else []),
    )
