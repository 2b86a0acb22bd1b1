"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One pass over the texts gives each document's shingle count, a digest of its shingle set and its
   band keys. Documents with equal sets are linked at once: the smallest id stands for all of them.
2. Representatives that share a band key are candidates. The candidates' components (over one edge
   from each member of a bucket to its smallest id) are clusters, so all candidates of a document lie
   in its own cluster, once, however many bands they share.
3. A cluster is dealt to cells of at most CELL documents and CELL_SHINGLES shingles on average. A task
   shingles the texts of a cell, counts the shingles that its documents share, and gives union-find
   links for the pairs that reach the similarity; pairs never leave a cell. A cluster of one cell is
   done then.
4. In a larger cluster each cell also gets a few of the cluster's documents as centres, which join the
   cells' groups. What isn't in the cluster's largest group afterwards is compared with the rest of the
   cluster, block by block, so no pair of candidates that could join two groups is left out.
5. A cluster of more than WIDE cells is taken apart into the buckets of its bands, which are dealt to
   cells in the same way; its documents then meet once for each band that they share.

40 bands of 5 ranks miss a pair of similarity 0.8 with probability 1.3e-7. Candidates need not share a
band with each other, only lie in one cluster, so more links than the bands' are found, none of them
below the similarity.

Defined results: null, empty and blank texts have no shingles and stand alone; a text with fewer
words than a shingle has one shingle, its whole word sequence; rows that repeat an id count as one
document, linked by any of their texts; a null id is replaced by a number from 2^62 on that its text
gives, so equal texts without ids count as one document, and a group takes such a number as its
component only if no other document is in it; an empty table gives no rows; other columns, whatever
their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import Stored, picked, small_batches, table, written

RANKS, BANDS, ROWS = 200, 40, 5
#: Documents and shingles of a cell, on average at most; clusters of more cells than WIDE are compared by bucket.
CELL, CELL_SHINGLES, WIDE = 1024, 1 << 19, 64
#: Documents of a large cluster that go to each of its cells, about so many.
CENTRES = 8
#: Distinct words that a task remembers the hashes of before it starts afresh.
WORDS = 1 << 20
#: A node's links to larger nodes are dealt to one task for each so many sets, and to at most so many tasks.
TASK_SETS, MOST_SALTS = 5_000_000, 16
LINK = "u bigint, v bigint"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Shingle sets of texts. As a dictionary it holds the hashes of the words that it has met."""

    def __init__(self, k: int) -> None:
        self.k = k

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct shingles of each text as sorted 64-bit hashes; A-Z are lower-cased, words are runs without ASCII white space."""
        if len(self) > WORDS:
            self.clear()
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        counts = [len(w) for w in split]
        every = np.fromiter((self[x] for w in split for x in w), np.uint64, sum(counts))
        n = max(len(every) - self.k + 1, 0)
        # A shingle's hash mixes in its words' hashes one after another.
        grams = np.zeros(n, np.uint64)
        for i in range(self.k):
            grams = _mixed(grams * np.uint64(31) + every[i : i + n] + _GOLD)
        out, at = [], 0
        for c in counts:
            if c == 0:
                out.append(np.empty(0, np.uint64))
            elif c < self.k:
                h = np.full(1, c, np.uint64)
                for x in every[at : at + c]:
                    h = _mixed(h * np.uint64(31) + x + _GOLD)
                out.append(h)
            else:
                out.append(np.unique(grams[at : at + c - self.k + 1]))
            at += c
        return out


def shingles(text: str | None, k: int) -> np.ndarray:
    return Shingler(k).sets([text])[0]


def super_minhash(sets: list[np.ndarray], m: int = RANKS, chunk: int = 1 << 15) -> np.ndarray:
    """SuperMinHash signatures (documents x m) of hashed sets.

    Each element walks its own random permutation of the m slots; at step j it offers j + u, with u
    uniform in [0, 1), to the slot it comes to. A slot keeps its smallest offer, so the ranks of an
    element are correlated, and a set is done as soon as none of its slots is above j.
    """
    # Sets of like size together, as small ones take many steps.
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for at in range(0, len(every), chunk):
        x, d = every[at : at + chunk], doc[at : at + chunk]
        walk = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
        for j in range(m):
            open_docs = out[d[0] : d[-1] + 1].max(axis=1) >> np.uint64(32) >= np.uint64(j)
            go = open_docs[d - d[0]]
            left = np.count_nonzero(go)
            if not left:
                break
            if left < 0.7 * len(x):  # offers to sets that are done change nothing, so they may stay for a while
                x, d, walk = x[go], d[go], walk[go]
            z = _mixed(x + np.uint64(int(_GOLD) * (j + 1) % 2**64))
            k = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            rows = np.arange(len(x))
            slot = walk[rows, k]
            walk[rows, k] = walk[:, j]
            np.minimum.at(flat, d * m + slot, (np.uint64(j) << np.uint64(32)) | (z >> np.uint64(32)))
    back = np.empty_like(out)
    back[order] = out
    return back


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of the first bands * rows ranks."""
    n = len(signatures)
    parts = signatures[:, : bands * rows].reshape(n, bands, rows)
    key = _mixed(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (n, bands)).copy())
    for i in range(rows):
        key = _mixed(key + _GOLD * parts[:, :, i])
    return key.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], k: int, enough: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    shingler, kept, sets = Shingler(k), [], []

    def flushed() -> pa.RecordBatch:
        keys = band_keys(super_minhash(sets))
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1), pa.int64()))
        return pa.RecordBatch.from_arrays([
            *(pa.concat_arrays([b.column(i) for b in kept]) for i in range(2)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists,
        ], ["doc_id", "node", "n", "digest", "keys"])

    for b in batches:
        kept.append(b.select([0, 1]))
        sets += shingler.sets(b.column(2).to_pylist())
        if sum(map(len, sets)) >= enough:
            yield flushed()
            kept, sets = [], []
    if sets:
        yield flushed()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None, rare: int = 8, columns: int = 4096) -> np.ndarray:
    """How many shingles each left set has in common with each right one (or left one): a table of at most a cell's documents each way.

    Shingles of up to `rare` sets count pair by pair, the others as products of 0-1 blocks.
    """
    sets, n = left + (right or []), len(left)
    size = len(sets)
    owner = np.repeat(np.arange(size), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
    held = np.diff(np.concatenate((starts, [len(flat)])))
    pairs = [np.empty(0, np.int64)]
    for d in range(2, rare + 1):
        rows = owner[starts[held == d][:, None] + np.arange(d)]
        if len(rows):
            pairs += [rows[:, a] * size + rows[:, b] for a in range(d) for b in range(a + 1, d)]
    out = np.bincount(np.concatenate(pairs), minlength=size * size).reshape(size, size)
    out = out + out.T
    out = out[:, n:] if right is not None else out
    out = out[:n]
    starts, held = starts[held > rare], held[held > rare]
    for at in range(0, len(starts), columns):
        s, h = starts[at : at + columns], held[at : at + columns]
        ends = np.cumsum(h)
        which = owner[np.repeat(s - ends + h, h) + np.arange(ends[-1])]
        block = np.zeros((size, len(s)), np.float32)
        block[which, np.repeat(np.arange(len(s)), h)] = 1
        out += (block[:n] @ (block[n:] if right is not None else block).T).astype(np.int64)
    return out


def _roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a symmetric table of links reaches."""
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = place.copy()
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(label)).min(axis=1))
        low = np.minimum(low, low[np.argsort(place)[low]])
        if (low == label).all():
            return np.sort(ids, kind="stable")[label]
        label = low


def _links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links (u, v) of a cell from sets (node, group, shingles): u's smallest linked node is v.

    Without right ones all pairs of left ones are compared, else those of a left and a right one in different groups.
    """
    both = left + right
    if len(both) < 2:
        return []
    ids, groups, sizes = np.array([x[0] for x in both]), np.array([x[1] for x in both]), np.array([len(x[2]) for x in both])
    n, of_right = len(left), slice(len(left), None) if right else slice(None)
    met = shared_counts([x[2] for x in left], [x[2] for x in right] if right else None)
    near = 100 * met >= percent * (sizes[:n, None] + sizes[of_right][None, :] - met)
    if right:
        whole = np.zeros((len(both), len(both)), bool)
        whole[:n, n:] = near & (groups[:n, None] != groups[n:][None, :])
        near = whole | whole.T
    # Rows that repeat an id are one node.
    near |= ids[:, None] == ids[None, :]
    root = _roots(near, ids)
    return list({(int(u), int(v)) for u, v in zip(ids, root, strict=True) if u != v})


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of cells that come one after another (kind, scope, i, j, left, node, grp, whole, text)."""
    shingler, cell, sides, whole, last = Shingler(k), None, ([], []), False, None
    found: list[tuple] = []
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        lefts, nodes, groups, wholes, texts = (b.column(i).to_pylist() for i in range(4, 9))
        for at, s in enumerate(shingler.sets(texts)):
            if keys[at] != cell:
                found += [(u, v, whole) for u, v in _links(*sides, percent)]
                cell, sides, whole, last = keys[at], ([], []), wholes[at], None
            this = (lefts[at], nodes[at], texts[at])
            if this != last:
                sides[0 if lefts[at] else 1].append((nodes[at], groups[at], s))
            last = this
        if len(found) > 4096:
            yield _link_batch(found)
            found = []
    found += [(u, v, whole) for u, v in _links(*sides, percent)]
    if found:
        yield _link_batch(found)


def _link_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["u", "v", "whole"])


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links: the smallest id that the ends of each link reach."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            return ids[label[a]], ids[label[b]]
        label = new


def _contract(batches: Iterator[pa.RecordBatch], block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links (u, v, side), in blocks: the distinct links of ends to their roots.

    side 0: the link is known here, 1: both its ends are written here, 2: its first one is, if its root is news.
    """
    held: list[pa.RecordBatch] = []

    def contracted() -> pa.RecordBatch:
        u, v, side = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        a, b = roots(u, v)
        links = np.concatenate((np.stack((u, a), 1)[(side == 1) | (side == 2) & (a != v)], np.stack((v, b), 1)[side == 1]))
        links = np.unique(links[links[:, 0] != links[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, i], pa.int64()) for i in range(2)], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= block:
            yield contracted()
            held = []
    if held:
        yield contracted()


def components(links: DataFrame, keep: Stored, salts: int = 1) -> DataFrame:
    """id and component (smallest id reachable) of every node of links (u, v).

    In each round the links of a node meet in a task, which contracts them by union-find; so paths get
    shorter by half at least. The links of a node to larger ones are dealt to `salts` tasks, and those to
    smaller ones are known to all of these.
    """
    while True:
        for _ in range(2):
            u, v, salt = F.greatest("u", "v"), F.least("u", "v"), F.pmod(F.xxhash64(F.greatest("u", "v")), F.lit(salts)).cast("int")
            to = [F.struct(u.alias("x"), F.lit(i).alias("salt"), F.lit(int(i == 0)).alias("side")) for i in range(salts)]
            ends = F.array(*to, F.struct(v.alias("x"), salt.alias("salt"), F.lit(2).alias("side")))
            links = links.select(u.alias("u"), v.alias("v"), F.explode(ends).alias("to")).repartition("to.x", "to.salt").select("u", "v", "to.side").mapInArrow(_contract, LINK)
        links = keep.written(links, "dup-links")
        ends = F.array(F.struct(F.col("u").alias("id"), "v"), F.struct(F.col("v").alias("id"), "v"))
        label = links.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.min("e.v").alias("component"), (F.min("e.v") < F.max("e.v")).alias("open"))
        label = keep.written(label, "dup-labels")
        if not label.agg(F.max("open")).first()[0]:
            return label.drop("open")


def node_of(doc_id: Column, text: Column) -> Column:
    """A document's number: its id, or one that its text gives."""
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).bitwiseOR(F.lit(1 << 62)))


def _in_cells(texts: DataFrame, rows: DataFrame, keep: Stored, k: int, percent: int) -> DataFrame:
    """Links of the cells that rows (id, kind, scope, i, j, left, grp, whole) name, with the texts of their ids."""
    met = picked(texts, rows, F.col("node") == F.col("id"), keep.written).select("kind", "scope", "i", "j", "left", "node", "grp", "whole", "text")
    dealt = met.repartition("kind", "scope", "i", "j").sortWithinPartitions("kind", "scope", "i", "j", "left", "node", F.xxhash64("text"))
    return dealt.mapInArrow(lambda it: _compare(it, k, percent), "u bigint, v bigint, whole boolean")


def _scopes(members: DataFrame, kind: int, cell: int, cell_shingles: int) -> DataFrame:
    """members (id, n, scope) with kind, size and p, the number of cells of the scope."""
    by = members.groupBy(F.col("scope").alias("s")).agg(F.count(F.lit(1)).alias("size"), F.ceil(F.greatest(F.count(F.lit(1)) / cell, F.sum("n") / cell_shingles)).cast("int").alias("p"))
    return members.join(by.hint("shuffle_hash"), members["scope"] == by["s"]).select("id", "n", F.lit(kind).alias("kind"), "scope", "size", "p")


def _links_of(texts: DataFrame, reps: DataFrame, keep: Stored, k: int, percent: int, cell: int, cell_shingles: int, wide: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (u, v) that are final, and links that still have to be put together; None where there are none."""
    bands = reps.select("id", "n", F.posexplode("keys").alias("band", "key"))
    least = bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("key").alias("shared"), "least")
    # A document has at most BANDS buckets. It is linked to the smallest id of all of them, and their other smallest ids are too.
    near = bands.join(least.hint("shuffle_hash"), F.col("key") == F.col("shared")).where("id != least").groupBy("id").agg(F.collect_set("least").alias("near"))
    near = near.withColumn("v", F.array_min("near"))
    links = near.select(F.explode(F.array_append(F.array_remove("near", F.col("v")), F.col("id"))).alias("u"), "v").distinct()
    salts = min(MOST_SALTS, 1 + reps.count() // TASK_SETS)
    cluster = components(links, keep, salts).withColumnRenamed("id", "i")
    members = reps.select("id", "n").join(cluster.hint("shuffle_hash"), F.col("id") == F.col("i")).select("id", "n", F.col("component").alias("scope"))
    scopes = keep.written(_scopes(members, 0, cell, cell_shingles), "dup-scopes")
    cells = scopes.agg(F.max("p")).first()[0] or 0
    if cells > wide:
        ids = scopes.where(F.col("p") > wide).select(F.col("id").alias("i")).distinct()
        open_bands = bands.join(ids.hint("shuffle_hash"), F.col("id") == F.col("i")).select("id", "n", F.col("key").alias("scope"))
        own = _scopes(open_bands, 1, cell, cell_shingles).where("size > 1")
        scopes = keep.written(scopes.where(F.col("p") <= wide).union(own), "dup-scopes")
    slot = F.pmod(F.xxhash64("id", F.lit("slot")), "p").cast("int")
    centre = F.abs(F.xxhash64("id", F.lit("centre"))) / F.lit(float(2**63)) * F.col("size") < CENTRES
    every = F.sequence(F.lit(0), F.col("p") - 1)
    first = scopes.select("id", "kind", "scope", F.explode(F.when((F.col("p") > 1) & centre, every).otherwise(F.array(slot))).alias("i"), ((F.col("p") == 1) & (F.col("kind") == 0)).alias("whole"))
    first = first.select("id", "kind", "scope", "i", F.col("i").alias("j"), F.lit(True).alias("left"), F.col("id").alias("grp"), "whole")
    links = keep.written(_in_cells(texts, first, keep, k, percent), "dup-edges")
    done, rest = links.where("whole"), links.where("not whole").select("u", "v")
    if cells <= 1:
        return done, None
    large = scopes.where("p > 1")
    label = components(rest, keep, salts).withColumnRenamed("id", "i")
    named = keep.written(large.join(label.hint("shuffle_hash"), F.col("id") == F.col("i"), "left").select("id", "n", "kind", "scope", "p", F.coalesce("component", "id").alias("grp")), "dup-named")
    sizes = named.groupBy("kind", "scope", "grp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    main = sizes.groupBy(F.col("kind").alias("k"), F.col("scope").alias("s")).agg(
        F.max(F.struct("size", "grp")).alias("most"), F.sum("size").alias("docs"), F.sum("n").alias("n"), F.max(F.struct("size", "n")).alias("held"),
    ).where("docs > most.size")
    main = main.select("k", "s", F.col("most.grp").alias("main"), F.ceil(F.greatest((F.col("docs") - F.col("most.size")) / cell, (F.col("n") - F.col("held.n")) / cell_shingles)).cast("int").alias("po"))
    outer = keep.written(named.join(main.hint("shuffle_hash"), (F.col("kind") == F.col("k")) & (F.col("scope") == F.col("s"))), "dup-open")
    if not outer.count():
        return done, rest
    # What isn't in the scope's largest group goes to one row of blocks, and each document to one column.
    of_row, of_column = F.pmod(F.xxhash64("id", F.lit("row")), "po").cast("int"), slot
    columns = ["id", "kind", "scope", "i", "j", "left", "grp", F.lit(False).alias("whole")]
    apart = outer.where("grp != main").select("id", "kind", "scope", of_row.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("left"), "grp")
    others = outer.select("id", "kind", "scope", F.explode(F.sequence(F.lit(0), F.col("po") - 1)).alias("i"), of_column.alias("j"), F.lit(False).alias("left"), "grp")
    more = keep.written(_in_cells(texts, apart.select(*columns).union(others.select(*columns)), keep, k, percent), "dup-edges")
    return done, rest.union(more.select("u", "v"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", cell: int = CELL, cell_shingles: int = CELL_SHINGLES, wide: int = WIDE
) -> DataFrame:
    """doc_id, node (doc_id or what stands for it), n_shingles, digest of the shingle set, component_id for every row of docs."""
    small_batches(docs.sparkSession)
    with Stored(docs.sparkSession) as keep:
        own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), node_of(F.col(doc_id), F.col(text)).alias("node"), F.col(text).alias("text"))
        signed = keep.written(own.mapInArrow(lambda it: _sign(it, k), "doc_id bigint, node bigint, n bigint, digest binary, keys array<bigint>"), "dup-signed")
        sets = signed.where("digest is not null")
        reps = keep.written(sets.groupBy("digest").agg(F.min("node").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "dup-reps")
        done, rest = _links_of(own.select("node", "text"), reps, keep, k, percent, cell, cell_shingles, wide)
        repeated = signed.groupBy("node").agg((F.min("digest") < F.max("digest")).alias("twice"))
        if repeated.agg(F.max("twice")).first()[0]:
            # An id with several sets links what stands for them.
            rows = signed.join(repeated.where("twice").select(F.col("node").alias("m")).hint("shuffle_hash"), F.col("node") == F.col("m")).select("node", F.col("digest").alias("d"))
            ties = rows.join(reps.select("digest", "id"), F.col("d") == F.col("digest")).where("node != id").select(F.col("node").alias("u"), F.col("id").alias("v"))
            every = done.select("u", "v").union(ties)
            label = components(every.union(rest) if rest is not None else every, keep)
        else:
            label = done.select(F.col("u").alias("id"), F.col("v").alias("component"))
            label = label.union(components(rest, keep)) if rest is not None else label
        label = label.withColumnRenamed("id", "i")
        named = reps.select("digest", "id").join(label.hint("shuffle_hash"), F.col("id") == F.col("i"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "id").alias("g"))
        out = signed.join(named.hint("shuffle_hash"), F.col("digest") == F.col("d"), "left")
        return keep.result(out.select("doc_id", "node", F.col("n").alias("n_shingles"), "digest", F.coalesce("g", "node").alias("component_id")), "duplicates")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one row of each group: that of the smallest id, with any of its rows if the id is repeated."""
    found = near_duplicates(docs, k, percent)
    keep = found.where("node = component_id").groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    keep = written(keep, "dup-kept")
    row, node = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), node_of(docs["doc_id"], docs["text"]).alias("own")
    rows = docs.select(row, node).join(keep.hint("shuffle_hash"), F.col("own") == F.col("node"))
    out = rows.where("rows = 1").select("row.*")
    if (keep.agg(F.max("rows")).first()[0] or 0) <= 1:
        return out
    return out.unionByName(rows.where("rows > 1").dropDuplicates(["own"]).select("row.*"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), k=2)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("node") == F.col("component_id")).alias("kept"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM inter i JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, c) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT b, c FROM reach JOIN both_ways ON id = a
)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM sizes JOIN reach ON id = doc_id GROUP BY doc_id, n
"""
