"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the
shared folder and reads them again as the next stage's documents.

Defined results: null, empty and blank texts fail the quality stage's base rules; an empty table gives
empty ones all along; of rows that repeat an id, and of groups of copies, one row stays; a null id is a
document like others; the mix repeats rows; other columns, whatever their names, pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import mixing, neardup, packing, quality, secrets
from tidemill.llm.shared import Run, fresh_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op3 rejects go: those that fail a base rule, and those that the weighed votes reject."""
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays."""
    return neardup.one_of_each(docs, k=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars keeps the length of the source text. With a ledger that stays, a later run scans only what it hasn't seen."""
    ledger = secrets.scan(docs, ledger_path or fresh_path(spark, "secret-ledger"))
    return secrets.redacted(docs, ledger)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, repeats as rows."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in the packed sequences."""
    return packing.pack(docs, packing.default_tokenizer(), with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages' verdicts, groups and packing can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Run(spark) as own:
        for name, stage in STAGES:
            rows = stage(spark, docs, sf_dir, ledger_path) if stage is secret_stage else stage(spark, docs, sf_dir)
            path = fresh_path(spark, f"pipeline-{name}")
            rows.write.parquet(path)
            docs = spark.read.schema(rows.schema).parquet(path)
            own.release(path)  # a stage's rows are all that the next one needs
    return docs
