"""Near-duplicate vectors: window collisions on sorted random projections, exact cosines, union-find grouping.

1. Equal vectors of a label are one class, so copies meet once, in an aggregation.
2. A label of more than CELL classes is cut at the mean of leading projections, one for each halving. A class
   has its home on its own sides of all cuts, and visits the cells that its window on each leading projection
   reaches into. Two classes of different cells meet in the cell of the higher number, if each window reaches,
   so every pair is tried at most once.
3. A cell is dealt to tasks as blocks of at most CELL classes that meet block by block; a task's memory
   depends on CELL only. It sorts its classes by each of PROJECTIONS random projections. A query's window on a
   projection is a run of ranks around its own value; a pair's count is the number of projections on which the
   one lies in the other's window.
4. Pairs that reach a count are verified by their cosine in double precision. The count is the largest one
   that a pair of exactly the threshold's cosine misses with a probability of at most MISS: the projected
   difference of two unit vectors of distance d is normal with deviation d, so the collisions of a pair are
   binomial.
5. A task returns the number of links of its classes and union-find links to the smallest class that each
   reaches, never pairs.

With windows of two deviations, 16 projections and MISS 1e-6 a pair needs 9 collisions; a pair of unrelated
vectors has them with probability 0.003. A leading cut loses a pair of the threshold's cosine with
probability 2e-5, a closer one less. Recall is measured against brute force in the tests.

Classes that are alike but not equal have as many links as pairs, and each of these is tried: a group of n such
classes costs n * n / CELL rows in a shuffle, in tasks of bounded size.

Defined results: null, empty and zero vectors, such with null or non-finite components, and vectors without a
label have no links and stand for themselves; vectors of different lengths aren't linked; rows that repeat an
id are vectors of their own and count as links of each other where they reach the cosine; a component is named
by its smallest id, nulls aside; an empty table gives no rows; other columns play no part. Equal vectors are
told by two 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.neardup import components, roots
from tidemill.llm.shared import Stored, table

COSINE, PROJECTIONS, MISS, SEED = 0.98, 16, 1e-6, 11
#: Half widths of windows, in deviations of a pair at the threshold: for counts, and for reaching across a leading cut.
WINDOW, REACH = 2.0, 4.0
#: Classes of a block at most, and components of its vectors, about so many.
CELL, NUMBERS = 8192, 1 << 22
#: Tables of at most so many rows (of some hundred bytes) are broadcast.
FEW_ROWS = 50_000
#: Queries whose counts a task holds at a time, and pairs whose cosines.
QUERIES, PAIRS = 64, 1 << 14


def distance(cosine: float) -> float:
    """The distance of two unit vectors of a cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def needed(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold misses with a probability of at most `miss`."""
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def directions(dim: int, first: int, count: int) -> np.ndarray:
    """Normal directions, numbered from `first`: dim x count."""
    return np.stack([np.random.default_rng([SEED, dim, first + i]).standard_normal(dim) for i in range(count)], 1) if count else np.empty((dim, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each times a power of two that keeps its square within bounds: no cosine changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Block:
    """A block's classes: numbers, weights (copies), vectors, norms and projections."""

    def __init__(self, number: np.ndarray, weight: np.ndarray, x: np.ndarray, projections: np.ndarray) -> None:
        self.number, self.weight, self.x = number, weight, scaled(x)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.at = (self.x / self.norm[:, None]) @ projections

    def ranked(self) -> None:
        """Sorts the block by each projection: the sorted values and each class's rank."""
        order = np.argsort(self.at, axis=0, kind="stable")
        self.values = np.take_along_axis(self.at, order, 0)
        self.rank = np.empty(self.at.T.shape, np.uint16)
        np.put_along_axis(self.rank, order.T, np.arange(len(self.at), dtype=np.uint16)[None, :], 1)

    def counts(self, at: np.ndarray, half: float) -> np.ndarray:
        """Collisions of queries (projections at) with the ranked block: queries x classes."""
        out = np.zeros((len(at), len(self.at)), np.uint8)
        for j in range(at.shape[1]):
            low = np.searchsorted(self.values[:, j], at[:, j] - half, "left").astype(np.uint16)
            length = np.searchsorted(self.values[:, j], at[:, j] + half, "right").astype(np.uint16) - low
            out += (self.rank[j][None, :] - low[:, None]) < length[:, None]  # unsigned, so ranks below wrap around
        return out


def linked(left: Block, right: Block | None, cosine: float, half: float, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked pairs: of left classes with right ones, or among the left ones."""
    other = right or left
    other.ranked()
    for start in range(0, len(left.at), QUERIES):
        count = other.counts(left.at[start : start + QUERIES], half)
        i, j = np.nonzero(count >= need)
        i = i + start
        if right is None:
            i, j = i[j > i], j[j > i]
        if len(i) > count.size // 16:
            met = left.x[start : start + QUERIES] @ other.x.T
            near = met[i - start, j] >= cosine * (left.norm[i] * other.norm[j])
        else:
            near = np.zeros(len(i), bool)
            for a in range(0, len(i), PAIRS):
                p, q = i[a : a + PAIRS], j[a : a + PAIRS]
                near[a : a + PAIRS] = np.einsum("ij,ij->i", left.x[p], other.x[q]) >= cosine * (left.norm[p] * other.norm[q])
        if near.any():
            yield i[near], j[near]


def _links(left: Block, right: Block | None, cosine: float, half: float, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """number, links (copies counted) and the smallest class reached, of the classes that have a link here."""
    other = right or left
    sums = [np.zeros(len(left.number), np.int64), np.zeros(len(other.number), np.int64)]
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in linked(left, right, cosine, half, need):
        np.add.at(sums[0], i, other.weight[j])
        np.add.at(sums[1], j, left.weight[i])
        u, v = left.number[i], other.number[j]
        a, b = roots(u, v)
        forest.append(tuple(np.unique(np.concatenate((np.stack((u, a)), np.stack((v, b))), 1), axis=1)))
    if not forest:
        return (np.empty(0, np.int64),) * 3
    u, v = (np.concatenate(x) for x in zip(*forest, strict=True))
    a, b = roots(u, v)
    reached = dict(zip(np.concatenate((u, v)).tolist(), np.concatenate((a, b)).tolist(), strict=True))
    if right is None:
        number, links = left.number, sums[0] + sums[1]
    else:
        number, links = np.concatenate((left.number, right.number)), np.concatenate(sums)
    has = links > 0
    return number[has], links[has], np.array([reached[x] for x in number[has].tolist()], np.int64)


UNIT = ("label", "dim", "cell", "kind", "i", "k")
FOUND = "c bigint, links bigint, root bigint"


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, projections: int, miss: float) -> Iterator[pa.RecordBatch]:
    """FOUND rows of units that come one after another: the columns of UNIT, then own (of the home side), c, n, e."""
    half, need, drawn = WINDOW * distance(cosine), needed(projections, WINDOW, miss), {}
    unit, parts = None, []

    def done() -> pa.RecordBatch:
        dim = unit[1]
        if dim not in drawn:
            drawn.clear()
            drawn[dim] = directions(dim, 0, projections)
        own, number, weight, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        sides = [Block(number[s], weight[s], x[s], drawn[dim]) if s.any() else None for s in (own, ~own)]
        paired = unit[4] != unit[5] or unit[3]
        out = _links(sides[0], sides[1], cosine, half, need) if sides[0] and (sides[1] or not paired) else (np.empty(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["c", "links", "root"])

    for b in batches:
        keys = list(zip(*(b.column(n).to_pylist() for n in range(len(UNIT))), strict=True))
        e = b.column(len(UNIT) + 3)
        offsets, values = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False)
        own = b.column(len(UNIT)).to_numpy(zero_copy_only=False)
        number, weight = (b.column(len(UNIT) + n).to_numpy() for n in (1, 2))
        cuts = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            if keys[a] != unit:
                if unit is not None:
                    yield done()
                unit, parts = keys[a], []
            parts.append((own[a:z], number[a:z], weight[a:z], values[offsets[a] : offsets[z]].reshape(z - a, -1)))
    if unit is not None:
        yield done()


def _lead(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """Adds the leading projections of unit vectors to (label, dim, c, n, e)."""
    drawn: dict[int, np.ndarray] = {}
    for b in batches:
        dims, e = b.column(1).to_numpy(), b.column(4)
        offsets, values, out = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False), np.empty((b.num_rows, count))
        for dim in np.unique(dims).tolist():
            if dim not in drawn:
                drawn[dim] = directions(dim, 1 << 20, count)
            rows = np.flatnonzero(dims == dim)
            x = scaled(values[offsets[rows][:, None] + np.arange(dim)])
            out[rows] = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ drawn[dim]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * count), pa.array(out.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "lead"])


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can be linked: labelled, finite and not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def _celled(classes: DataFrame, keep: Stored, cell: int, cosine: float) -> DataFrame:
    """classes (label, dim, c, n, e) with home and cell, once for its home and once for each cell visited."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    cuts = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / F.lit(float(cell))))).cast("int")
    sizes = keep.written(sizes.withColumn("cuts", cuts), "vec-sizes")
    most = sizes.agg(F.max("cuts")).first()[0] or 0
    if not most:
        return classes.withColumns({"home": F.lit(0).cast("long"), "cell": F.lit(0).cast("long")})
    schema = f"label {dict(classes.dtypes)['label']}, dim int, c bigint, n bigint, e {dict(classes.dtypes)['e']}, lead array<double>"
    led = classes.select("label", "dim", "c", "n", "e").mapInArrow(lambda it: _lead(it, most), schema)
    # Rounded, so that the order of a sum doesn't move a cut.
    means = led.groupBy("label", "dim").agg(F.array(*[F.round(F.avg(F.col("lead")[j]), 2) for j in range(most)]).alias("means"))
    known = keep.written(sizes.join(means, ["label", "dim"]).select(F.col("label").alias("l"), F.col("dim").alias("d"), "cuts", "means"), "vec-cuts")
    led = led.join(_small(known), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    every = F.when(F.col("cuts") > 0, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array().cast("array<int>"))
    side = lambda j: (F.col("lead")[j] >= F.col("means")[j]).cast("long")
    near = lambda j: F.abs(F.col("lead")[j] - F.col("means")[j]) <= REACH * distance(cosine)
    home = F.aggregate(every, F.lit(0).cast("long"), lambda acc, j: acc * 2 + side(j))
    both = lambda acc: F.flatten(F.transform(acc, lambda x: F.array(x * 2, x * 2 + 1)))
    visits = F.aggregate(every, F.array(F.lit(0).cast("long")), lambda acc, j: F.when(near(j), both(acc)).otherwise(F.transform(acc, lambda x: x * 2 + side(j))))
    led = led.withColumn("home", home).withColumn("visits", visits)
    return led.select("label", "dim", "c", "n", "e", "home", F.explode(F.filter("visits", lambda x: x >= F.col("home"))).alias("cell"))


def _in_units(cells: DataFrame, keep: Stored, cell: int) -> DataFrame:
    """cells dealt to units (label, dim, cell, kind, i, k): kind 0 for two home blocks, 1 for a home block and one of visitors."""
    at_home = F.col("home") == F.col("cell")
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(cell)), F.lit(float(NUMBERS)) / F.greatest("dim", F.lit(1))))
    parts = lambda what: F.ceil(F.sum(what.cast("long")) / block).cast("int")
    sizes = cells.select("label", "dim", "cell", at_home.alias("at_home")).groupBy("label", "dim", "cell").agg(parts(F.col("at_home")).alias("p"), parts(~F.col("at_home")).alias("v"), F.count(F.lit(1)).alias("size"))
    sizes = keep.written(sizes.where("p > 0 and size > 1"), "vec-cells").select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("w"), "p", "v")
    met = cells.join(_small(sizes), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("w")))
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda kind, i, k, own: F.struct(F.lit(kind).alias("kind"), i.alias("i"), k.alias("k"), own.alias("own"))
    a, b = F.pmod(F.xxhash64("c", F.lit("home")), F.col("p")).cast("int"), F.pmod(F.xxhash64("c", F.lit("visit")), F.greatest("v", F.lit(1))).cast("int")
    homes = F.concat(F.transform(upto(F.col("p")), lambda k: unit(0, F.least(a, k), F.greatest(a, k), a <= k)), F.transform(upto(F.col("v")), lambda k: unit(1, a, k, F.lit(True))))
    guests = F.transform(upto(F.col("p")), lambda i: unit(1, i, b, F.lit(False)))
    dealt = met.select("label", "dim", "cell", F.explode(F.when(at_home, homes).otherwise(guests)).alias("u"), "c", "n", "e")
    dealt = dealt.select("label", "dim", "cell", "u.kind", "u.i", "u.k", "u.own", "c", "n", "e")
    return dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL, projections: int = PROJECTIONS, miss: float = MISS
) -> DataFrame:
    """vec_id, n_links (other vectors linked), component_id (smallest id reachable) of every row of vectors."""
    if not 1 <= cell <= 1 << 15:
        raise ValueError("a cell has 1 to 32768 classes")
    with Stored(vectors.sparkSession) as keep:
        fit = usable(vectors[vector], vectors[label])
        h = [F.when(fit, F.xxhash64(vectors[vector])), F.when(fit, F.xxhash64(F.lit("again"), vectors[vector]))]
        rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), vectors[vector].alias("e"), h[0].alias("h"), h[1].alias("h2"))
        classes = rows.where("h is not null").groupBy("label", "h", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("e").alias("e"))
        classes = keep.written(classes.withColumns({"dim": F.size("e"), "c": F.monotonically_increasing_id()}), "vec-classes")
        units = _in_units(_celled(classes.select("label", "dim", "c", "n", "e"), keep, cell, cosine), keep, cell)
        found = keep.written(units.mapInArrow(lambda it: _compare(it, cosine, projections, miss), FOUND), "vec-links")
        links = found.groupBy("c").agg(F.sum("links").alias("links"))
        label_of = components(found.where("c != root").select(F.col("c").alias("u"), F.col("root").alias("v")), keep)
        named = classes.select("c", "id").join(label_of, F.col("c") == label_of["id"]).select("c", classes["id"], "component")
        names = named.groupBy("component").agg(F.min("id").alias("name")).withColumnRenamed("component", "k")
        known = named.join(names, F.col("component") == F.col("k")).select(F.col("c").alias("c2"), "name").join(links.withColumnRenamed("c", "c3"), F.col("c2") == F.col("c3"))
        whole = classes.select(F.col("label").alias("l"), F.col("h").alias("g"), F.col("h2").alias("g2"), "id", "n", "c").join(known, F.col("c") == F.col("c2"), "left")
        whole = whole.select("l", "g", "g2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "id").alias("component_id"))
        same = (F.col("label") == F.col("l")) & (F.col("h") == F.col("g")) & (F.col("h2") == F.col("g2"))
        out = rows.drop("e").join(whole.hint("shuffle_hash"), same, "left")
        return keep.result(out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "near-vectors")


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98 * (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, c FROM reach JOIN both_ways ON id = a),
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM embeddings JOIN reach ON id = vec_id LEFT JOIN n ON a = vec_id GROUP BY vec_id
"""
