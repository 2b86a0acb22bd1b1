"""Helpers that the training-data operators share: the shared folder, text columns and span columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
#: What the paths given out are noted in: of the run that this thread or task is in, if it is in one.
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary folder serves a single machine, as in tests; on a cluster it is an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (run := _run.get()) is not None:
        run.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stored:
    """Tables of one operator in the shared folder. As a context it removes them at the end, but for its result."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Rows that stay after the other tables have gone."""
        return written(df, name)

    def __enter__(self) -> Stored:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Run:
    """A run that owns the paths given out inside it, as a context: other runs of the process have their own."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Run:
        self._before = _run.set(self.paths)
        return self

    def release(self, *keep: str) -> None:
        """Removes the run's tables but for those to keep. DataFrames that read them can't be used any more."""
        for path in self.paths:
            if path not in keep:
                remove(self.spark, path)
        self.paths[:] = keep

    def __exit__(self, *_: object) -> None:
        _run.reset(self._before)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts can be long, so Arrow batches are kept to few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank texts."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


SPAN = "array<struct<start:int,end:int,hit:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each prefix of an array, for an associative op: a pass for each doubling of the reach, so no accumulator grows with each element."""
    shifts = F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k) < F.size(values)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(shifts, values, lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, op(F.get(acc, i - d), v)).otherwise(v)))


def totals(values: Column) -> Column:
    """Running sums of an array of integers."""
    return running(values, lambda a, b: (a + b).cast("int"))


def regex_spans(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that has no empty match, as (start, end, hit) in code points.

    split() and regexp_extract_all() walk the same matches, so the running sums of the lengths of the parts
    between the matches and of the matches are their places. before and after: so many characters around a match
    at most, as further fields; after, not more than a match is long.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("part"), hits.alias("hit"))
    kind = SPAN[:-2] + (",before:string,after:string>>" if before or after else ">>")
    length = lambda p: (F.length(p["part"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("int")

    def spans(ps: Column) -> Column:
        def placed(p: Column, end: Column) -> Column:
            return F.struct((end - F.length(p["hit"])).cast("int").alias("start"), end.alias("end"), p["hit"].alias("hit"))

        out = F.zip_with(ps, totals(F.transform(ps, length)), placed)
        if before or after:
            tail = running(F.transform(ps, lambda p: F.right(F.concat(p["part"], F.coalesce(p["hit"], F.lit(""))), F.lit(before))), lambda a, b: F.right(F.concat(a, b), F.lit(before)))

            def around(tails: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    own, following = F.get(ps, i), F.get(ps, i + 1)
                    led = F.right(F.concat(F.when(i > 0, F.get(tails, i - 1)).otherwise(""), own["part"]), F.lit(before))
                    return F.struct(x["start"], x["end"], x["hit"], led.alias("before"), F.left(F.concat(following["part"], F.coalesce(following["hit"], F.lit(""))), F.lit(after)).alias("after"))

                return F.transform(out, one)

            out = let(tail, around)
        return F.filter(out, lambda x: x["hit"].isNotNull())

    return F.when(text.rlike(pattern), let(pairs, spans)).otherwise(F.array().cast(kind))


def distinct_sorted(values: Column) -> Column:
    """The distinct values of an array in order, by comparing neighbours."""
    return let(F.array_sort(values), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def picked(docs: DataFrame, keys: DataFrame, on: Column, put: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """docs joined with the few rows of keys, which `put` writes to a table in the shared folder.

    Spark is asked to filter docs by a Bloom filter of the keys (its size is bounded by Spark's
    settings) before it shuffles their texts; the hash table is that of one partition of keys.
    """
    conf = docs.sparkSession.conf
    conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    return docs.join(put(keys.withColumn("__n", F.lit(1)), "picked").where("__n > 0").hint("shuffle_hash"), on)
