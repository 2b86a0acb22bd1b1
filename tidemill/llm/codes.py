"""Vector codes: exact integer Lloyd rounds over parts of vectors, with trees over parts and over entries.

1. Rows are gathered in blocks of at most BLOCK vectors. Components become integers, floor(256 * x), each of the
   16 part positions gets a balanced tree over its block's parts (halved along the widest side of each node), and
   the blocks are stored in tree order with their positions, so each round reads trees, not vectors.
2. A round sends the codebooks (16 x 64 entries, a bounded size) to the blocks. A tree over each codebook's
   entries is walked together with the tree over its parts, level by level: of a node's pairs with entry nodes
   those go whose least distance is above another pair's greatest one. A node with one entry left is assigned
   whole, by its cached sums. At leaves, the entries left are compared part by part with integers, ties to the
   lower index.
3. Each task returns a count and sums for each entry that it used, and these are added up by (part, entry): 1,024
   rows go to the driver, which divides them into the next codebooks. After two rounds the parts are assigned
   once more, for codes and errors.

All bounds and distances are integers, so results don't depend on blocks, tasks or their order. Blocks or
codebooks with integers of 2^28 or more are computed with Python's unbounded integers, without trees.

Defined results: rows whose vector is null or holds null or non-finite components go; vectors of different
lengths have codebooks of their own; lengths that 16 doesn't divide are cut at i * length / 16, rounded down;
the first 64 rows are those of the smallest ids, null ids last, and by their vectors where ids repeat; with
fewer rows there are fewer entries; errors above the largest long are given as that; label_error adds up over
vectors of all lengths; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import Stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block at most, components of a block about so many, and parts of a tree's leaf.
BLOCK, NUMBERS, LEAF = 1 << 14, 1 << 20, 16
#: Below this, squared distances of up to 64 components fit into 64 bits; parts with more take the exact path from a lower bound on.
SMALL = 1 << 28
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def whole(x: float) -> int:
    """floor(256 * x), of any finite size."""
    return int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as 64-bit integers, or as Python's if one is too large."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def cuts(dim: int) -> list[int]:
    return [i * dim // PARTS for i in range(PARTS + 1)]


def fits(values: np.ndarray, width: int) -> bool:
    """Whether distances between such values are sure to fit into 64 bits."""
    return values.dtype != object and (not values.size or int(np.abs(values).max()) ** 2 * 4 * max(width, 1) < 2**62)


def shape(n: int, leaf: int) -> tuple[int, int]:
    """Depth and places of a balanced tree over n points."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    return depth, -(-n // (1 << depth)) << depth


class Tree:
    """A balanced tree over points: order, and the box, sum and count of each node of each level, the root's first.

    The last level's nodes are leaves of equal size; places beyond the points repeat the last one and count nothing.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None) -> None:
        n = len(points)
        self.depth, size = shape(n, leaf)
        order = self.split(points, n, size) if order is None else order
        self.order, self.real = order, order < n
        self.points = points[np.minimum(order, n - 1)]
        rows = self.points.reshape(1 << self.depth, size >> self.depth, -1)
        live = self.real.reshape(1 << self.depth, -1)
        low, high = rows.min(1), rows.max(1)
        sums, count = (rows * live[:, :, None]).sum(1), live.sum(1)
        self.levels = [(low, high, sums, count)]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            sums, count = sums[::2] + sums[1::2], count[::2] + count[1::2]
            self.levels.insert(0, (low, high, sums, count))

    def split(self, points: np.ndarray, n: int, size: int) -> np.ndarray:
        """An order in which each node of each level is a run."""
        order = np.arange(size)[None, :]
        for _ in range(self.depth):
            rows = points[np.minimum(order, n - 1)]
            wide = (rows.max(1) - rows.min(1)).argmax(1)
            key = np.take_along_axis(rows, wide[:, None, None], 2)[:, :, 0]
            order = np.take_along_axis(order, np.argsort(key, axis=1, kind="stable"), 1).reshape(2 * len(order), -1)
        return order.reshape(-1)


def least_and_most(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest squared distance between points of pairs of boxes."""
    apart = np.maximum(np.maximum(low - high2, low2 - high), 0)
    far = np.maximum(np.abs(high2 - low), np.abs(high - low2))
    return (apart * apart).sum(1), (far * far).sum(1)


def firsts(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))


def walked(parts: Tree, entries: Tree) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Walks both trees: (entry, level, node) of nodes assigned whole, and the (leaf, entry) pairs that the bounds leave open."""
    alone_at, p, e = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(parts.depth, entries.depth) + 1):
        at, at2 = min(level, parts.depth), min(level, entries.depth)
        if level:  # to the children of both, of one where the other has come to its leaves
            ways, ways2 = 1 + (level <= parts.depth), 1 + (level <= entries.depth)
            i, k = np.divmod(np.arange(ways * ways2), ways2)
            p, e = (p[:, None] * ways + i).reshape(-1), (e[:, None] * ways2 + k).reshape(-1)
            order = np.argsort(p, kind="stable")
            p, e = p[order], e[order]
        low, high, _, count = parts.levels[at]
        low2, high2, _, real = entries.levels[at2]
        there = (count[p] > 0) & (real[e] > 0)
        p, e = p[there], e[there]
        if not len(p):
            break
        least, most = least_and_most(low[p], high[p], low2[e], high2[e])
        starts = firsts(p)
        held = np.diff(np.append(starts, len(p)))
        left = least <= np.repeat(np.minimum.reduceat(most, starts), held)
        p, e = p[left], e[left]
        if at2 == entries.depth:
            starts = firsts(p)
            alone = np.repeat(np.diff(np.append(starts, len(p))) == 1, np.diff(np.append(starts, len(p))))
            alone_at += [(entry, at, node) for entry, node in zip(entries.order[e[alone]].tolist(), p[alone].tolist(), strict=True)]
            p, e = p[~alone], e[~alone]
            if not len(p):
                break
    return alone_at, p, entries.order[e]


def assigned(parts: Tree, book: np.ndarray, used: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and squared distance at each of the tree's places; `used` gets (entry, count, sums)."""
    places, size = len(parts.order), len(parts.order) >> parts.depth
    nearest = np.zeros(places, np.int64)
    alone, p, e = walked(parts, Tree(book, 1))
    for entry, level, node in alone:
        nearest[node * (places >> level) : (node + 1) * (places >> level)] = entry
        if used is not None:
            _, _, sums, count = parts.levels[level]
            used.append((entry, int(count[node]), sums[node]))
    if len(p):
        starts = firsts(p)
        node, held = p[starts], np.diff(np.append(starts, len(p)))
        for k in np.unique(held).tolist():  # leaves of as many open entries at a time
            rows = held == k
            which = np.sort(e[starts[rows][:, None] + np.arange(k)], axis=1)
            spots = node[rows][:, None] * size + np.arange(size)
            gap = parts.points[spots][:, :, None, :] - book[which][:, None, :, :]
            pick = (gap * gap).sum(3).argmin(2)  # the first of the least, so ties go to the lower index
            nearest[spots] = np.take_along_axis(which, pick, 1)
            if used is not None:
                spots = spots.reshape(-1)[parts.real[spots.reshape(-1)]]
                sums, n = np.zeros(book.shape, np.int64), np.bincount(nearest[spots], minlength=len(book))
                np.add.at(sums, nearest[spots], parts.points[spots])
                used += [(int(i), int(n[i]), sums[i]) for i in np.flatnonzero(n)]
    gap = parts.points - book[nearest]
    return nearest, (gap * gap).sum(1)


def exactly(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with integers of any size, entry by entry."""
    points, book = points.astype(object), book.astype(object)
    nearest, best = np.zeros(len(points), np.int64), None
    for i, entry in enumerate(book):
        far = ((points - entry) ** 2).sum(1) if points.shape[1] else np.array([0] * len(points), object)
        if best is None:
            best = far
        else:
            nearer = (far < best).astype(bool)
            nearest[nearer], best = i, np.where(nearer, far, best)
    return nearest, best


SUMS = "part int, entry int, n bigint, sums array<string>"


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (id, label, vector): integers and a tree order for each part position; a block with large integers keeps its doubles, without orders."""
    held, rows, at = [], 0, cuts(dim)
    most = max(1, min(block, NUMBERS // max(dim, 1)))

    def stored(t: pa.Table) -> pa.RecordBatch:
        x = np.asarray(t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, dim)
        v = integers(x)
        orders = [] if v.dtype == object else [Tree(v[:, a:z], LEAF).order.astype(np.int32).tobytes() for a, z in zip(at, at[1:], strict=False) if z > a]
        named = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(i).combine_chunks()) for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.array([(v if orders else x).tobytes()]), pa.array([b"".join(orders)]), *named], ["block", "orders", "ids", "labels"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        while rows >= most:
            every = pa.Table.from_batches(held)
            yield stored(every.slice(0, most))
            held, rows = every.slice(most).to_batches(), rows - most
    if rows:
        yield stored(pa.Table.from_batches(held))


def of_block(block: bytes, orders: bytes, n: int, dim: int, books: list[np.ndarray], used: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and errors of a block's rows; `used` gets (part, entry, count, sums)."""
    at, places, codes, errors = cuts(dim), shape(n, LEAF)[1], np.zeros((n, PARTS), np.int64), np.zeros(n, object)
    v = np.frombuffer(block, np.int64).reshape(n, dim) if orders else integers(np.frombuffer(block, np.float64).reshape(n, dim))
    start = 0
    for part, (a, z) in enumerate(zip(at, at[1:], strict=False)):
        x, book = v[:, a:z], books[part]
        order = np.frombuffer(orders, np.int32, places, start).astype(np.int64) if orders and z > a else None
        start += 4 * places * (z > a)
        if order is not None and fits(x, z - a) and fits(book, z - a):
            tree, found = Tree(x, LEAF, order), None if used is None else []
            nearest, far = assigned(tree, book, found)
            codes[order[tree.real], part] = nearest[tree.real]
            errors[order[tree.real]] += far[tree.real]
        else:
            codes[:, part], far = exactly(x, book)
            errors += far
            mine = [codes[:, part] == i for i in range(len(book))]
            found = [(i, int(m.sum()), x[m].astype(object).sum(0)) for i, m in enumerate(mine) if m.any()]
        if used is not None:
            used += [(part, *f) for f in found]
    return codes, errors


def _summed(rows: Iterator[tuple[int, int, int, list]]) -> pa.RecordBatch:
    total: dict[tuple[int, int], list] = {}
    for part, entry, n, sums in rows:
        now = total.setdefault((part, entry), [0, [0] * len(sums)])
        now[0] += n
        now[1] = [a + int(b) for a, b in zip(now[1], sums, strict=True)]
    keys = list(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([[str(s) for s in total[k][1]] for k in keys], pa.list_(pa.string()))],
        ["part", "entry", "n", "sums"],
    )


def _of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, pa.Array, pa.Array]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].values, b.column(3)[i].values


def _round(batches: Iterator[pa.RecordBatch], dim: int, books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """SUMS of a task's blocks."""

    def used() -> Iterator[tuple]:
        for block, orders, ids, _ in _of_batches(batches):
            found: list = []
            of_block(block, orders, len(ids), dim, books, found)
            yield from ((part, entry, n, sums.tolist()) for part, entry, n, sums in found)

    yield _summed(used())


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _summed(tuple(r.values()) for b in batches for r in b.to_pylist())


def _coded(batches: Iterator[pa.RecordBatch], dim: int, books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])
    for block, orders, ids, labels in _of_batches(batches):
        codes, errors = of_block(block, orders, len(ids), dim, books)
        text = ["".join(r) for r in hexes[codes].tolist()]
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array([min(int(x), LONG) for x in errors], pa.int64())], ["vec_id", "label", "code", "error"])


def trained(blocks: DataFrame, dim: int, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after some rounds; entries that no part uses stay."""
    for _ in range(rounds):
        now = books
        sums = blocks.mapInArrow(lambda it: _round(it, dim, now), SUMS).repartition("part", "entry").mapInArrow(_add, SUMS)  # noqa: B023
        books = [b.astype(object) for b in books]
        for r in sums.collect():  # a row for each entry in use, 1,024 at most
            books[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        books = [narrow(b) for b in books]
    return books


def narrow(x: np.ndarray) -> np.ndarray:
    """64-bit integers where all values are small enough."""
    return x.astype(np.int64) if not x.size or max(abs(v) for v in x.reshape(-1).tolist()) < SMALL * 2 else x


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error, label_error, codebooks_sha256 and codebooks (JSON) of the rows kept."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vectors[vector])).select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), vectors[vector].alias("e"))
    kinds = dict(rows.dtypes)
    coded = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    with Stored(spark) as keep:
        done = spark.createDataFrame([], f"{coded}, codebooks_sha256 string")
        for (dim,) in sorted(rows.select(F.size("e").alias("dim")).distinct().collect()):
            own = rows.where(F.size("e") == dim)
            first = own.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(ENTRIES).collect()
            start = integers(np.array([r["e"] for r in first], np.float64).reshape(len(first), dim))
            at = cuts(dim)
            books = [narrow(start[:, a:z].astype(object)) for a, z in zip(at, at[1:], strict=False)]
            blocks = own.mapInArrow(lambda it, dim=dim: _blocks(it, dim, block), f"block binary, orders binary, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>")
            blocks = keep.written(blocks, "code-blocks")
            books = trained(blocks, dim, books)
            out = blocks.mapInArrow(lambda it, dim=dim, books=books: _coded(it, dim, books), coded)
            done = done.union(out.withColumn("codebooks_sha256", F.lit(digest(books))))
        done = keep.written(done, "codes")
        total = done.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
        return keep.result(done.join(total, F.col("label").eqNullSafe(F.col("l"))).drop("l"), "vector-codes")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_NEAREST = """n{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, arg_min(b.entry, (b.d, b.entry)) AS entry, min(b.d) AS d FROM parts p, LATERAL (
    SELECT entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM b{k} c WHERE c.part = p.part
  ) b GROUP BY p.vec_id, p.part
)"""
_BOOK = """b{k} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, o.x) AS x FROM b{j} o LEFT JOIN (
    SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
      SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
        SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM n{j} JOIN parts USING (vec_id, part)
      ) GROUP BY ALL
    ) GROUP BY part, entry
  ) m USING (part, entry)
)"""
OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS nth
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, nth, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM kept, range(16) r(part)
), b0 AS MATERIALIZED (SELECT part, nth AS entry, x FROM parts WHERE nth < 64),
{_NEAREST.format(k=0)}, {_BOOK.format(k=1, j=0)}, {_NEAREST.format(k=1)}, {_BOOK.format(k=2, j=1)}, {_NEAREST.format(k=2)},
codes AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN kept USING (vec_id), book
"""
