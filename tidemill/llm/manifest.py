"""Merkle dataset manifest: per-source trees over documents, a tree over sources, proofs and their verification.

1. One pass over the texts gives each row's leaf, a digest of its fields. What follows moves digests only.
2. Leaves are dealt out by ranges of (source, doc_id) and numbered inside each range; the ranges' row counts
   give each leaf its place in its source, so no task holds a source.
3. A level at a time: a window over each run of 16 places reads siblings at fixed lag and lead offsets, masked
   by the node's slot and the run's length; the run's first child hashes its parent from its own digest and
   those that follow. A level has a sixteenth of the rows of the one below, and a tree stops at one node.
4. From the root down, each node's path is its siblings and then its parent's path, which the run's nodes meet
   by (tree, run), the partitioning that their window has already.

Defined results: a null field counts as `-`, so empty and null texts differ; rows that repeat an id are ordered
by their leaves, and equal rows are leaves of their own; a null id comes first in its source and is never
tampered with; null is a source, the first one; a lone leaf is its source's subroot; an only source's subroot
is the root; a document without siblings has the digest of nothing as its proof; an empty table gives no rows;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.shared import Stored, ascii_lower, sha256, table

#: Children of a node.
WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A value as UTF-8 byte count, colon and value; `-` if it is null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return sha256(F.concat(*[field(fields[f]) for f in FIELDS]))


def numbered(rows: DataFrame, group: str, order: list[str], keep: Stored) -> tuple[DataFrame, DataFrame]:
    """rows (stored) with part and row, and a table of part and group with first, before and n.

    A row's place in its group by the order, nulls first, is row - first + before.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = keep.written(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "manifest-ranges")
    # A group has a row for each range that it reaches into.
    parts = dealt.groupBy(group, "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return dealt, keep.written(parts, "manifest-parts")


def siblings(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, digest, count) with run, slot, and the digests of the run's nodes to the left and to the right, put together."""
    placed = nodes.withColumns({"run": F.floor(F.col("pos") / WIDTH), "slot": F.pmod("pos", F.lit(WIDTH))})
    of_run = F.least(F.lit(WIDTH), F.col("count") - F.col("run") * WIDTH)
    w = Window.partitionBy("tree", "run").orderBy("pos")
    before = [F.when(F.col("slot") >= i, F.lag("digest", i).over(w)) for i in range(WIDTH - 1, 0, -1)]
    after = [F.when(F.col("slot") + i < of_run, F.lead("digest", i).over(w)) for i in range(1, WIDTH)]
    return placed.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def grown(leaves: DataFrame, keep: Stored) -> list[DataFrame]:
    """All levels of the trees above leaves (tree, pos, digest, count), these first; a level's nodes of count 1 are tops."""
    levels, most = [leaves], leaves.agg(F.max("count")).first()[0] or 0
    while most > 1:
        first = siblings(levels[-1].where("count > 1")).where("slot = 0")
        parents = first.select("tree", F.col("run").alias("pos"), sha256(F.concat("digest", "right")).alias("digest"), F.ceil(F.col("count") / WIDTH).alias("count"))
        levels.append(keep.written(parents, "manifest-level"))
        most = -(-most // WIDTH)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    out = None
    for nodes in levels:
        rows = nodes.where("count = 1").select("tree", "digest")
        out = rows if out is None else out.union(rows)
    return out


def paths(levels: list[DataFrame], over: DataFrame | None = None) -> DataFrame:
    """The first level's rows with path, the (left, right) siblings of each level up to the root, and top, the digest of the tree's top.

    over: the path above each tree's top node (tree, path), nothing if None.
    """
    above = None
    for nodes in reversed(levels):
        lone = nodes.where("count = 1").withColumn("top", F.col("digest"))
        if over is None:
            lone = lone.withColumn("path", F.array().cast(STEP))
        else:
            lone = lone.join(over.select(F.col("tree").alias("__tree"), "path"), F.col("tree") == F.col("__tree")).drop("__tree")
        here = lone.select(*nodes.columns, "path", "top")
        if above is not None:
            up = above.select(F.col("tree").alias("__tree"), F.col("pos").alias("__pos"), F.col("path").alias("__path"), "top")
            met = siblings(nodes.where("count > 1")).join(up, (F.col("tree") == F.col("__tree")) & (F.col("run") == F.col("__pos")))
            path = F.concat(F.array(F.struct("left", "right")), F.col("__path"))
            here = here.union(met.withColumn("path", path).select(*nodes.columns, "path", "top"))
        above = here
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, leaf, lambda digest, step: sha256(F.concat(step["left"], digest, step["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, position, leaf, tampered (leaf after tampering, else null), subroot, root, path of every row of docs."""
    with Stored(docs.sparkSession) as keep:
        own = {f: docs[f] for f in FIELDS}
        hit = F.pmod(F.crc32(own["doc_id"].cast("string")), F.lit(5)) == 0
        tampered = F.when(hit, leaf_of(own | {"text": ascii_lower(own["text"])}))
        leaves = keep.written(docs.select(own["doc_id"], own["source"], leaf_of(own).alias("digest"), tampered.alias("tampered")), "manifest-leaves")
        dealt, parts = numbered(leaves, "source", ["doc_id", "digest"], keep)
        sources = parts.groupBy("source").agg(F.sum("n").alias("count")).withColumn("all", F.lit(0))
        named, spans = numbered(sources, "all", ["source"], keep)
        total = spans.agg(F.sum("n")).first()[0] or 0
        tree = named.join(spans.select(F.col("part").alias("p"), "first", "before"), F.col("part") == F.col("p")).select(
            "source", (F.col("row") - F.col("first") + F.col("before")).alias("tree"), "count"
        )
        tree = keep.written(tree, "manifest-sources").select(F.col("source").alias("s"), "tree", "count")
        place = parts.join(tree, parts["source"].eqNullSafe(tree["s"])).select(F.col("source").alias("s"), F.col("part").alias("p"), "first", "before", "tree", "count")
        rows = dealt.join(place, dealt["source"].eqNullSafe(place["s"]) & (dealt["part"] == place["p"]))
        rows = keep.written(rows.select("tree", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "digest", "count", "doc_id", "source", "tampered"), "manifest-nodes")
        levels = grown(rows, keep)
        subroots = keep.written(tops(levels).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(total).cast("long").alias("count")), "manifest-subroots")
        upper = grown(subroots, keep)
        root = tops(upper).first()
        over = keep.written(paths(upper).select(F.col("pos").alias("tree"), "path"), "manifest-over")
        out = paths(levels, over).select(
            "doc_id", "source", F.col("pos").alias("position"), F.col("digest").alias("leaf"), "tampered", F.col("top").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"), "path"
        )
        proof = sha256(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""))
        return keep.result(out.withColumns({"proof_sha256": proof, "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))}).drop("path"), "manifest")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:-1]) + " || " + _FIELD.format("{text}") + ")"
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), leaves AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN crc % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents LEFT JOIN crc USING (doc_id)
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS sid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS cnt FROM leaves
), tree AS (
  SELECT sid, 0 AS lvl, pos, leaf AS digest, cnt FROM placed
  UNION ALL
  SELECT sid, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (cnt + 15) // 16 FROM tree WHERE cnt > 1 GROUP BY sid, lvl, pos // 16, cnt
), subroots AS (
  SELECT sid, digest, count(*) OVER () AS cnt FROM tree WHERE cnt = 1
), upper AS (
  SELECT 0 AS sid, 0 AS lvl, sid - 1 AS pos, digest, cnt FROM subroots
  UNION ALL
  SELECT sid, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (cnt + 15) // 16 FROM upper WHERE cnt > 1 GROUP BY sid, lvl, pos // 16, cnt
), runs AS (
  SELECT sid, lvl, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM (SELECT * FROM tree WHERE cnt > 1 UNION ALL SELECT * FROM upper WHERE cnt > 1) GROUP BY ALL
), sides AS (
  SELECT sid, lvl, run * 16 + i - 1 AS pos, coalesce(array_to_string(ds[:i - 1], ''), '') AS l, coalesce(array_to_string(ds[i + 1:], ''), '') AS r
  FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM runs)
), climb AS (
  SELECT row_number() OVER () AS k, doc_id, leaf, sid AS home, sid, 0 AS lvl, pos, cnt, coalesce(tampered, leaf) AS acc, '' AS proof, false AS done, (SELECT max(cnt) FROM subroots) AS sources FROM placed
  UNION ALL
  SELECT k, doc_id, leaf, home, CASE WHEN cnt = 1 THEN 0 ELSE c.sid END, CASE WHEN cnt = 1 THEN 0 ELSE c.lvl + 1 END, CASE WHEN cnt = 1 THEN c.sid - 1 ELSE c.pos // 16 END,
    CASE WHEN cnt = 1 THEN sources ELSE (cnt + 15) // 16 END, CASE WHEN cnt = 1 THEN acc ELSE sha256(l || acc || r) END, CASE WHEN cnt = 1 THEN proof ELSE proof || l || r END, false, sources
  FROM climb c LEFT JOIN sides s ON c.sid = s.sid AND c.lvl = s.lvl AND c.pos = s.pos WHERE NOT (c.sid = 0 AND cnt = 1)
)
SELECT c.doc_id, c.leaf, s.digest AS subroot, u.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = u.digest AS verified
FROM climb c JOIN subroots s ON s.sid = home JOIN upper u ON u.cnt = 1 WHERE c.sid = 0 AND c.cnt = 1
"""
