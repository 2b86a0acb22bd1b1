"""Sources: files in several formats, whole folders, optional inputs, storage profiles, dated slices."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.scratch import path_exists
from tidemill.sources.snapshots import is_snapshot_table, read_snapshot

#: Which storage profile a run reads, by intent.
PROFILES = {"daily": "raw_append", "backfill": "rollup_cold", "features": "serving_entity", "inference": "serving_entity"}
#: Order of tiers under a preference; tiers that aren't named come last.
TIERS = {"daily": ("daily", "monthly", "yearly"), "monthly": ("monthly", "daily", "yearly"), "yearly": ("yearly", "monthly", "daily")}


def read_files(spark: SparkSession, paths: str | list[str], fmt: str = "parquet", recursive: bool = False, union_by_name: bool = False, pattern: str | None = None, schema: str | None = None) -> DataFrame:
    """parquet, csv (header, inferred types), json, jsonl; gzip by file extension; schemas of parquet files united by name on request. A snapshot table gives its newest snapshot."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if schema:
        reader = reader.schema(schema)
    if fmt == "parquet":
        if isinstance(paths, str) and is_snapshot_table(spark, paths):
            return read_snapshot(spark, paths)
        return reader.option("mergeSchema", union_by_name).parquet(*([paths] if isinstance(paths, str) else paths))
    if fmt == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).option("mode", "FAILFAST").csv(paths)
    if fmt in ("json", "jsonl"):
        return reader.option("multiLine", fmt == "json").option("mode", "FAILFAST").json(paths)
    raise ValueError(f"unknown format {fmt!r}")


def register(spark: SparkSession, sources: Mapping[str, Mapping[str, Any]], base: str = "") -> None:
    """Views of declared sources {path | sql | table, format, required, empty_schema: {column: type}}.

    A missing optional source with empty_schema becomes an empty typed view, a missing required one an error.
    """
    for name, s in sources.items():
        if s.get("sql"):
            df = spark.sql(s["sql"])
        elif s.get("table"):
            df = spark.table(s["table"])
        else:
            path = s["path"] if re.match(r"^(/|\w+:)", s["path"]) or not base else f"{base}/{s['path']}"
            if "*" in path or path_exists(spark, path):
                df = read_files(spark, path, s.get("format", "parquet"), s.get("recursive", False), s.get("union_by_name", False))
            elif s.get("empty_schema") and not s.get("required", True):
                df = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in s["empty_schema"].items()))
            else:
                raise FileNotFoundError(f"source {name!r}: {s['path']} (at {path}) doesn't exist")
        df.createOrReplaceTempView(name)


def profile_path(spark: SparkSession, table: Mapping[str, Any], intent: str, override: str | None = None, prefer: str = "local") -> str:
    """The first path that exists among those of the intent's profile, else of the default storage; local or remote ones first."""
    profile = table.get("profiles", {}).get(override or PROFILES.get(intent, ""), table["storage"])
    order = ("local", "remote") if prefer == "local" else ("remote", "local")
    paths = [profile[k] for k in order if profile.get(k)]
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths} exists")


def with_tier(files: DataFrame, key: str = "key") -> DataFrame:
    """Adds tier, start_date and end_date from names that end in _YYYY_MM_DD, _YYYY_MM or _YYYY (before the extension)."""
    # The suffix is taken once; its number of parts says the tier.
    stem = F.regexp_replace(F.col(key), r"(\.[A-Za-z0-9]+)+$", "")
    out = files.withColumn("__parts", F.split(F.regexp_extract(stem, r"_(\d{4}(?:_\d{2}){0,2})$", 1), "_"))
    part, n = lambda i: F.get("__parts", F.lit(i)), F.size("__parts")
    start = F.concat_ws("-", part(0), F.coalesce(part(1), F.lit("01")), F.coalesce(part(2), F.lit("01"))).try_cast("date")
    out = out.withColumn("start_date", start).withColumn("tier", F.when(F.col("start_date").isNull(), None).when(n == 3, "daily").when(n == 2, "monthly").otherwise("yearly"))
    end = F.when(F.col("tier") == "daily", F.col("start_date")).when(F.col("tier") == "monthly", F.last_day("start_date")).when(F.col("tier") == "yearly", F.date_add(F.add_months("start_date", 12), -1))
    return out.withColumn("end_date", end).select(*files.columns, "tier", "start_date", "end_date")


def tier_priority(tier: Column, prefer: str) -> Column:
    out = F.lit(len(TIERS[prefer]))
    for i, t in enumerate(TIERS[prefer]):
        out = F.when(tier == t, i).otherwise(out)
    return out


def resolve_slices(catalogue: DataFrame, dates: DataFrame, prefer: str = "daily") -> DataFrame:
    """For each (table, date) the covering file by tier preference, then shortest span, then nearest start.

    catalogue has table, key, tier, start_date, end_date; dates has date, and table where each date is asked of one
    table only. A day lies in one day, one month and one year, so each date looks up three keys (table, tier,
    start); files of other spans meet dates by month. The best file is an aggregate, so nothing is sorted.
    """
    own = ["table"] if "table" in dates.columns else []
    days = dates.select(*own, F.col("date").cast("date").alias("date")).distinct()
    units = {"daily": "day", "monthly": "month", "yearly": "year"}
    ends = {"daily": F.col("start_date"), "monthly": F.last_day("start_date"), "yearly": F.date_add(F.add_months("start_date", 12), -1)}
    nested = F.lit(False)
    for tier, unit in units.items():
        nested |= (F.col("tier") == tier) & (F.col("start_date") == F.date_trunc(unit, "start_date").cast("date")) & (F.col("end_date") == ends[tier])
    nested = F.coalesce(nested, F.lit(False))
    start = F.array(*[F.struct(F.lit(t).alias("tier"), F.date_trunc(u, "date").cast("date").alias("start_date")) for t, u in units.items()])
    asked = days.select(*own, "date", F.explode(start).alias("k")).select(*own, "date", "k.*")
    met = asked.join(catalogue.where(nested), [*own, "tier", "start_date"]).select("date", *catalogue.columns)
    month = lambda c: F.trunc(c, "month")
    odd = catalogue.where(~nested & (F.col("start_date") <= F.col("end_date"))).withColumn("__month", F.explode(F.sequence(month("start_date"), month("end_date"), F.expr("interval 1 month"))))
    met = met.union(days.withColumn("__month", month("date")).join(odd, [*own, "__month"]).where("date between start_date and end_date").select("date", *catalogue.columns))
    order = F.struct(tier_priority(F.col("tier"), prefer), F.datediff("end_date", "start_date"), F.datediff("date", "start_date"), F.col("key"))
    rest = [c for c in catalogue.columns if c != "table"]
    best = met.groupBy("table", "date").agg(F.min_by(F.struct(*rest), order).alias("__file"))
    return best.select("date", *[F.col("table") if c == "table" else F.col(f"__file.{c}").alias(c) for c in catalogue.columns])


def read_slices(spark: SparkSession, base: str, resolved: DataFrame, date_column: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the resolved dates, each from the one file chosen for it, so mixed tiers aren't counted twice.

    All chosen files are one scan; a row stays if its file is the one of its date. Only file names, as many as
    the catalogue has, come to the driver.
    """
    keys = [r["key"] for r in resolved.select("key").distinct().collect()]
    if not keys:
        raise FileNotFoundError("no file covers the dates")
    rows = read_files(spark, [f"{base}/{k}" for k in sorted(keys)], fmt, union_by_name=True)
    chosen = resolved.select(F.col("key").alias("__key"), F.col("date").alias("__date")).distinct()
    # A key is a file, or a folder with part files; what a path has behind the base is its key.
    file = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "/part-[^/]*$", "")
    under = re.sub(r"^\w+:(//[^/]*)?", "", base).rstrip("/") + "/"
    at = F.instr(F.col("__file"), under)
    key = F.when(at > 0, F.substring("__file", at + len(under), F.length("__file")))
    rows = rows.select("*", file.alias("__file"), F.col(date_column).cast("date").alias("__day")).withColumn("__own", key)
    # A store may show files under another path than they were asked for by; then their ends tell.
    same = F.coalesce(F.col("__own") == F.col("__key"), F.col("__file").endswith(F.concat(F.lit("/"), F.col("__key"))))
    return rows.join(chosen, (F.col("__day") == F.col("__date")) & same, "left_semi").drop("__file", "__day", "__own")


def load_dataset(spark: SparkSession, name: str, base: str = "", fmt: str | None = None) -> DataFrame:
    """A registered relation of that name; else the file or folder at that path or under the base folder, its format by its ending."""
    if re.fullmatch(r"[\w.]+", name) and spark.catalog.tableExists(name):
        return spark.table(name)
    for path in (name, f"{base}/{name}", f"{base}/{name}.parquet"):
        if path_exists(spark, path):
            ending = re.search(r"\.(parquet|csv|jsonl|json)(\.gz)?$", path)
            return read_files(spark, path, fmt or (ending[1] if ending else "parquet"))
    raise FileNotFoundError(f"{name!r} is neither a relation nor a path")


def relations(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """name and temporary of the registered relations."""
    return spark.createDataFrame([(t.name, t.isTemporary) for t in spark.catalog.listTables(pattern=pattern)], "name string, temporary boolean")


def preview(df: DataFrame, rows: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first rows, in a stated order so that reruns agree."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)
