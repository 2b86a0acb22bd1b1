"""Canonical exact digests of documents.

A text's canonical form is its NFKC normalisation, case-folded, with runs of white space as single
spaces and none at the ends. Its fingerprint is the 128-bit xxh3 hash of that form in hex. Documents
with equal fingerprints form a bucket. Inside it the canonical bytes are compared by their SHA-256, of
which each partition passes on only the distinct ones, so a bucket of any size takes a few rows and no
texts are moved again; documents whose bytes differ from those of the bucket's least digest get theirs
added to the fingerprint, so equal fingerprints mean equal forms.

Neighbours: documents are dealt out by ranges of doc_id and sorted, descending, inside partitions;
a partition's last document meets the next partition's first one in a small join of edge rows.

Defined results: a null text is an empty one; a null id comes last; rows that repeat an id follow
one another by text; the likeness of two fingerprints is 1 if they are equal, else 0; a single
document is its own next one; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import small_batches, table, written

ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, digest binary"
EDGE = "part int, first boolean, text string"
_ROW_TYPES = [("doc_id", pa.int64()), ("n_chars", pa.int64())] + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")] + [("digest", pa.binary())]
_EDGE_TYPES = [("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string())]


def canonical(text: str | None) -> bytes:
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first characters of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def _marks(text: str) -> tuple[str, bytes]:
    """A text's fingerprint and the SHA-256 of its canonical form."""
    form = canonical(text)
    return xxhash.xxh3_128_hexdigest(form), hashlib.sha256(form).digest()


def _row(doc_id: int | None, text: str, own: str, digest: bytes, following: str, after: str) -> tuple:
    new = edited(text, following)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, own if new == text else fingerprint(new), after, digest)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for all documents of a sorted partition but the last; edge rows for its first and last ones."""
    part, last = TaskContext.get().partitionId(), None
    types = _ROW_TYPES + _EDGE_TYPES

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])

    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own, digest = _marks(text)
            if last is None:
                rows.append((None,) * 3 + (own,) + (None,) * 3 + (part, True, text))
            else:
                rows.append(_row(*last, text, own) + (None,) * 3)
            last = (doc_id, text, own, digest)
        if rows:
            yield batch(rows)
    if last:
        yield batch([(last[0], None, None, last[2], None, None, last[3], part, False, last[1])])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_row(*r) for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_ROW_TYPES)], [n for n, _ in _ROW_TYPES])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, digest of every row (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows of one id, or without any, are dealt by their texts' beginnings too, and equal ones by chance: their order is a matter of choice.
    dealt = own.repartitionByRange(n, by[0], F.substring("text", 1, 64).asc(), F.rand(9)).sortWithinPartitions(*by)
    rows = written(dealt.mapInArrow(_neighbours, f"{ROW}, {EDGE}"), "neighbours")
    edges = rows.where("part is not null")
    parts = sorted(r["part"] for r in edges.where("first").select("part").collect())  # a number a partition
    if not parts:
        return rows.drop("part", "first", "text")
    # The partition that follows each one: as many rows as partitions.
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, to int")
    last = edges.where("not first").select("part", "doc_id", "text", "fingerprint", "digest").join(F.broadcast(follows), "part")
    head = edges.where("first").select(F.col("part").alias("to"), F.col("text").alias("following"), F.col("fingerprint").alias("after"))
    joined = last.join(head, "to").select("doc_id", "text", "fingerprint", "digest", "following", "after")
    return rows.where("part is null").drop("part", "first", "text").unionByName(joined.mapInArrow(_edges, ROW))


def collisions(rows: DataFrame) -> DataFrame:
    """fingerprint and first (its least digest) of the buckets that hold different bytes."""
    held = rows.groupBy("fingerprint").agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
    return held.where("first <> last").select("fingerprint", "first")


def fingerprints(docs: DataFrame) -> DataFrame:
    """with_next() with the bucket check: fingerprints are made distinct where canonical bytes differ."""
    rows = with_next(docs)
    odd = written(collisions(rows), "collisions").select(F.col("fingerprint").alias("f"), "first")
    if odd.isEmpty():
        return rows
    both = rows.join(odd, F.col("fingerprint") == F.col("f"), "left")
    more = F.when(F.col("digest") != F.col("first"), F.lower(F.hex("digest")))
    return both.withColumn("fingerprint", F.concat_ws("-", "fingerprint", more)).drop("f", "first")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    like = lambda c: (F.substring("fingerprint", 1, 32) == F.substring(c, 1, 32)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
