"""Near vectors, vector codes and the manifest against brute force, on small and awkward inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import codes, manifest, vectors

VECTORS = "vec_id bigint, embedding array<float>, label int, dim int, c string"


def rows_of(seed=3, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((90, dim))
    near = base[:40] + r.standard_normal((40, dim)) * 0.1  # cosines around 0.98
    far = base[:20] + r.standard_normal((20, dim)) * 0.3
    group = base[0] + r.standard_normal((60, dim)) * 0.08
    x = np.concatenate((base, near, far, group, base[50:55], base[60:63] * 4)).astype(np.float32).tolist()
    rows = [(i, v, i % 3, dim, "x") for i, v in enumerate(x)]
    rows += [(1000 + i, v, 0, dim, "x") for i, v in enumerate(x[150:210])]  # copies and near ones of other labels
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] + [1.0] * (dim - 1), [math.inf] + [1.0] * (dim - 1), [3e38] * dim, [1e-38] * dim, x[0][: dim // 2]]
    rows += [(2000 + i, v, 1, dim, "x") for i, v in enumerate(odd)]
    rows += [(3000, x[0], None, dim, "x"), (3001, x[0], None, dim, "x"), rows[5], rows[5], (None, x[7], 1, dim, "x"), (None, x[8], 2, dim, "x")]
    return rows


def brute_links(rows, cosine):
    fit = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label, *_ in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if fit[i] and fit[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    root = list(range(len(rows)))
    done = set()
    for i in range(len(rows)):
        if i not in done:
            todo, seen = [i], {i}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            done |= seen
            ids = [rows[k][0] for k in seen if rows[k][0] is not None]
            for k in seen:
                root[k] = min(ids) if ids else None
    return sorted(((rows[i][0], len(links[i]), root[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("cell", [8192, 16, 3])
def test_near_vectors(spark, cell):
    rows = rows_of()
    got = vectors.near_vectors(spark.createDataFrame(rows, VECTORS), cell=cell)
    assert got.columns == ["vec_id", "n_links", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows, 0.98)


def test_near_vectors_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    only = [(1, None, None, 0, "x"), (2, [0.0], 1, 0, "x")]
    assert sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(only, VECTORS)).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_recall_at_the_threshold():
    """Pairs of exactly the cosine are found, across leading cuts too."""
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.9801 * x + math.sqrt(1 - 0.9801**2) * side
    drawn = vectors.directions(32, 0, vectors.PROJECTIONS)
    counts = (np.abs(x @ drawn - y @ drawn) <= vectors.WINDOW * vectors.distance(0.98)).sum(1)
    assert (counts >= vectors.needed()).mean() > 0.9995
    lead = vectors.directions(32, 1 << 20, 8)
    reach = vectors.REACH * vectors.distance(0.98)
    a, b = x @ lead, y @ lead
    apart = (np.sign(a) != np.sign(b)) & ((np.abs(a) > reach) | (np.abs(b) > reach))
    assert apart.any(axis=1).mean() < 0.001


def test_needed_counts_fall_with_the_recall_asked_for():
    assert vectors.needed(miss=1e-9) < vectors.needed(miss=1e-6) < vectors.needed(miss=1e-2) <= 16


def brute_codes(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out, hashes = [], {}
    for dim in {len(r[1]) for r in kept}:
        mine = [(r[0], r[2], [codes.whole(float(np.float32(x))) for x in r[1]]) for r in kept if len(r[1]) == dim]
        at = [i * dim // 16 for i in range(17)]
        parts = [[v[a:z] for _, _, v in mine] for a, z in zip(at, at[1:], strict=False)]
        books = [[list(x) for x in p[:64]] for p in parts]
        nearest = lambda x, book: min(range(len(book)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(x, book[i], strict=True)), i))
        for _ in range(2):
            for p, book in zip(parts, books, strict=True):
                near = [nearest(x, book) for x in p]
                for i in range(len(book)):
                    own = [x for x, n in zip(p, near, strict=True) if n == i]
                    if own:
                        book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)] if own[0] else []
        hashes[dim] = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
        for k, (i, label, _) in enumerate(mine):
            near = [nearest(p[k], book) for p, book in zip(parts, books, strict=True)]
            far = sum((a - b) ** 2 for p, book, n in zip(parts, books, near, strict=True) for a, b in zip(p[k], book[n], strict=True))
            out.append((i, label, "".join(f"{n:02x}" for n in near), min(far, codes.LONG), hashes[dim]))
    total = {}
    for _, label, _, e, _ in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, label, c, e, h, min(total[label], codes.LONG)) for i, label, c, e, h in out), key=str)


@pytest.mark.parametrize("block", [codes.BLOCK, 40])
def test_vector_codes(spark, block):
    rows = rows_of(5, 64)
    got = codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


def test_vector_codes_of_plain_and_few_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, v, i % 2 or None, 1, "c") for i, v in enumerate(r.standard_normal((700, 64)).round(1).astype(np.float32).tolist())]  # many ties
    for some in (rows, rows[:3], []):
        got = codes.vector_codes(spark.createDataFrame(some, VECTORS))
        assert sorted(map(tuple, got.collect()), key=str) == brute_codes(some)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 64), st.integers(1, 5), st.sampled_from([1, 3, 50, 100000]), st.integers(0, 10**6))
def test_walk_of_two_trees(n, k, width, size, seed):
    r = np.random.default_rng(seed)
    x, book, used = r.integers(-size, size, (n, width)), r.integers(-size, size, (k, width)), []
    tree = codes.Tree(x, codes.LEAF)
    near, far = codes.assigned(tree, book, used)
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (near[tree.real] == d.argmin(1)[tree.order[tree.real]]).all() and (far[tree.real] == d.min(1)[tree.order[tree.real]]).all()
    for i in range(k):
        mine = d.argmin(1) == i
        assert sum(m for e, m, _ in used if e == i) == mine.sum() and (sum((s for e, _, s in used if e == i), np.zeros(width, int)) == x[mine].sum(0)).all()


def test_whole_nodes_are_assigned_by_their_sums():
    x = np.concatenate([np.random.default_rng(1).integers(-5, 5, (256, 4)) + 1000 * i for i in range(4)])
    alone, p, _ = codes.walked(codes.Tree(x, codes.LEAF), codes.Tree(np.array([[1000 * i] * 4 for i in range(4)]), 1))
    assert len(p) == 0 and sorted(e for e, _, _ in alone) == [0, 1, 2, 3]


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree int"


def brute_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    out = []

    def climb(nodes):
        """The top and each node's (left, right) steps."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, i in enumerate(at):
                run = runs[i // 16]
                steps[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            nodes, at = [h(*r) for r in runs], [i // 16 for i in at]
        return nodes[0], steps

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *climb([leaf(r, r[1]) for r in own])))
    if not rows:
        return []
    root, upper = climb([t[1] for t in trees])
    for (own, subroot, steps), more in zip(trees, upper, strict=True):
        for r, up in zip(own, steps, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, lower(r[1])) if hit else leaf(r, r[1])
            for left, right in up + more:
                fold = h(left, fold, right)
            out.append((r[0], leaf(r, r[1]), subroot, root, h(*(x for p in up + more for x in p)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,sources", [(0, 1), (1, 1), (2, 2), (17, 1), (300, 4), (600, 40)])
def test_manifest(spark, tmp_path, n, sources):
    r = random.Random(n)
    text = lambda: r.choice([None, "", "Über Alles ABC", "plain", "Z" * 5000, "🎉 Mixed Case"])
    rows = [(i if i % 50 else None, text(), r.choice(["en", None]), r.choice([None, "", "Ä", "hot", "hot", *(f"s{k}" for k in range(sources))]) if sources > 1 else "s", r.choice([None, 7]), "clash", 1) for i in range(n)]
    rows += rows[3:5]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op12_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)
