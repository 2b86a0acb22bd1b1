"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a 63-bit hash. Its source's budget is a whole number of passes over the source
and a rest; the rest goes to the documents whose hash lies under the source's threshold. To find
it, sizes are summed by source and hash bucket (8 bits); the bucket in which the running sum crosses
the budget is split by the next 8 bits, and so on, so each step reads only that bucket's documents.

Defined results: null, empty and blank texts have size 0 and cost nothing; a null source is a source,
the last; documents with equal id and text share one hash and are taken together; reruns agree; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.shared import table, words, written

BITS, LEVELS = 8, 7
WEIGHTS = (1, 2, 3)
MOST = 3


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words and hash; written once, so the texts are read once."""
    h = F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND(F.lit(2**63 - 1))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), h.alias("hash"))


def source_order(sizes: DataFrame) -> DataFrame:
    """source, source_size and place (0, 1, ... by code point, null last), numbered in two steps without one task for all."""
    sums = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    by = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranged = sums.repartitionByRange(8, *by).withColumn("part", F.spark_partition_id())
    ranged = written(ranged.sortWithinPartitions(*by), "mix-ranges")
    own = Window.partitionBy("part").orderBy(*by)
    counts, offsets, before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), [], 0  # a row a partition
    for r in sorted(counts):
        offsets.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(sizes.sparkSession.createDataFrame(offsets, "part int, before bigint"))
    return ranged.join(starts, "part").select("source", "source_size", (F.col("before") + F.row_number().over(own) - 1).cast("long").alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of the total by weight, none above `most` times its source's size.

    The level is the target of a source of weight 1 that isn't held back. Each round takes out the
    sources that the level would lift above their limit; it only rises, so the rounds end.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(source_order(sizes).select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(most)).alias("limit")), "mix-weights")
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = F.col("limit") <= F.lit(level) * F.col("weight")
        held, free = rows.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not free or (new := (total - held) / free) <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("limit"), F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, passes (whole ones) and threshold: one pass more for hashes up to it.

    low is where the bucket starts in which the running sum of sizes crosses the budget, left what the
    budget has over before that bucket.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("passes", passes).select(
        "source", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("low"),
    )
    state = written(state, "mix-level")
    rows = sizes.select(F.col("source").alias("s"), "size", "hash")
    for level in range(LEVELS):
        shift = 63 - BITS * (level + 1)
        at = rows.join(state, rows["s"].eqNullSafe(state["source"]))
        if level:
            at = at.where(F.shiftright("hash", shift + BITS) == F.shiftright("low", shift + BITS))
        bars = at.groupBy("source", "left", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("sum"), (F.min("hash") < F.max("hash")).alias("more"),
        )
        bars = bars.withColumn("upto", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")))
        first = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "sum", "more"))).alias("bar")
        step = bars.groupBy(F.col("source").alias("s2")).agg(first, F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("before"))
        state = written(state.join(step, state["source"].eqNullSafe(step["s2"]), "left").select(
            "source", "source_size", "target", "passes", (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"),
            F.coalesce(F.shiftleft("bar.bucket", shift), F.lit(0)).alias("low"),
            F.coalesce("bar.sum", F.lit(0)).alias("sum"), F.coalesce("bar.more", F.lit(False)).alias("more"),
        ), "mix-level")
        if state.where("more").isEmpty():
            break
        state = state.drop("sum", "more") if level < LEVELS - 1 else state
    # The last bucket holds one hash: it is taken if that brings the sum nearer to the budget.
    take = (F.col("sum") > 0) & (2 * F.col("left") >= F.col("sum"))
    return state.select("source", "source_size", "target", "passes", F.when(take, F.col("low") + (2**shift - 1)).otherwise(F.col("low") - 1).alias("threshold"))


def mix(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, hash, size, source, source_size, target, times (how often the mix takes the document)."""
    rows = written(sized(docs, **columns), "mix-sizes")
    plan = thresholds(rows, targets(rows)).withColumnRenamed("source", "s")
    out = rows.join(plan, rows["source"].eqNullSafe(plan["s"]))
    times = F.col("passes") + F.when((F.col("hash") <= F.col("threshold")) & (F.col("passes") < MOST), 1).otherwise(0)
    return out.select("doc_id", "hash", "size", "source", "source_size", "target", times.alias("times"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as its source's passes and threshold say. Rows travel as one struct, whatever their columns' names."""
    rows = written(sized(docs), "mix-sizes")
    plan = thresholds(rows, targets(rows)).select(F.col("source").alias("s"), "passes", "threshold")
    names = docs.columns
    h = F.xxhash64(docs["doc_id"], docs["text"]).bitwiseAND(F.lit(2**63 - 1))
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), docs["source"].alias("own"), h.alias("hash"))
    out = own.join(plan, own["own"].eqNullSafe(plan["s"]))
    times = F.col("passes") + F.when((F.col("hash") <= F.col("threshold")) & (F.col("passes") < MOST), 1).otherwise(0)
    each = F.sequence(F.lit(1).cast("long"), times)
    return out.where(times > 0).select("row", F.explode(each).alias("copy")).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
