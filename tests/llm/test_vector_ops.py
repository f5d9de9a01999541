"""Exact search, clustering and filter audit against brute force and SQL."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import dual_tree_kmeans, filter_audit, topk_search
from tests.oracle import compare

VECTORS = "vec_id long, embedding array<float>, score string, cluster string, cell string"


@pytest.mark.parametrize("module", [topk_search, dual_tree_kmeans, filter_audit])
def test_queries_match_sql(spark, sf, module):
    for name, sql in module.ORACLES.items():
        assert compare(spark, sf, module.QUERIES[name], sql) > 0


def ints(v, size=None):
    if v is None or any(x is None or not math.isfinite(x) for x in v) or (size is not None and len(v) != size):
        return None
    out = [math.floor(1024 * float(np.float32(x))) for x in v]
    return out if sum(x * x for x in out) < 1 << 60 else None


def odd_vectors(rng, n, dim):
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]
    hot = [rng.gauss(0, 0.3) for _ in range(dim)]
    rows += [(1000 + i, hot) for i in range(n // 2)]  # one very common vector, so ties
    rows += [(7, rows[7][1]), (7, rows[7][1]), (0, rows[0][1]), (100, rows[3][1]), (200, rows[3][1])]  # repeated rows, and ids with two vectors
    rows += [(300, None), (400, [None] * dim), (500, [float("nan")] + [0.0] * (dim - 1)), (600, [float("inf")] * dim), (700, [3e38] * dim), (None, hot)]
    rows += [(800, [0.1, 0.2]), (801, [0.3, 0.1]), (802, [-0.3, 0.1]), (900, []), (901, []), (1100, [0.0] * dim)]
    rng.shuffle(rows)
    return rows


def brute_top_k(rows, k):
    usable = [(i, v) for i, x in rows if i is not None and (v := ints(x)) is not None]
    queries = {(i, tuple(v)) for i, v in usable if i % 100 == 0}
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in usable if i != q and len(c) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim,k,seed", [(64, 10, 1), (13, 3, 2), (5, 60, 3)])
def test_search_against_all_products(spark, dim, k, seed, monkeypatch):
    rows = odd_vectors(random.Random(seed), 260, dim)
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0, k).collect())
    assert got == brute_top_k(rows, k)


def test_search_drops_candidates_and_stays_exact():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 100, (3000, 64))).astype(np.int64)
    x[50] = 9 * x[10]
    ids = np.arange(3000)
    block = topk_search._block(ids, x)
    slabs = [topk_search.widen(raw, 8, 3000) for raw in block["slabs"]]
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            read.append(len(key[1]) if isinstance(key, tuple) else 0)
            return np.asarray(super().__getitem__(key))

    masses = np.frombuffer(block["masses"], np.int64).reshape(8, 3000)
    for q in range(0, 60, 10):
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        scores, names = topk_search.search_block(x[q], q, ids, [s.view(Counted) for s in slabs], masses, none, 10)
        all_ = sorted((-int(x[q] @ x[i]), i) for i in range(3000) if i != q)[:10]
        assert [(-s, i) for s, i in zip(scores.tolist(), names.tolist())] == all_
    assert min(r for r in read if r) < 300  # later slabs are read at few candidates


def test_search_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert topk_search.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], "", "", "")], VECTORS)
    assert topk_search.top_k(one, F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        topk_search.top_k(one, F.col("vec_id") % 100 == 0, 0)


def brute_lloyd(rows, k, rounds, seed, dim):
    kept = [(i, v) for i, x in rows if (v := ints(x, dim)) is not None]
    mark = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cents = [v for i, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own) if o == j] for j in range(len(cents))]
        cents = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, cents)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, o in last if o == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), digest[o]) for i, d, o in last), key=str)


@pytest.mark.parametrize("dim,k,n,seed", [(64, 8, 150, 1), (3, 8, 400, 2), (2, 25, 300, 3), (64, 8, 2, 4)])
def test_clusters_against_plain_lloyd(spark, dim, k, n, seed):
    rows = odd_vectors(random.Random(seed), max(n, 8), dim)[: n * 2]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in dual_tree_kmeans.centroid_clusters(df, k, 4, 3, dim).collect()), key=str)
    assert got == brute_lloyd(rows, k, 4, 3, dim)


def test_clusters_of_nothing_and_of_one_vector(spark):
    assert dual_tree_kmeans.centroid_clusters(spark.createDataFrame([(1, [1.0], "", "", "")], VECTORS)).count() == 0
    same = spark.createDataFrame([(i % 5, [0.5] * 64, "", "", "") for i in range(40)], VECTORS)
    got = dual_tree_kmeans.centroid_clusters(same).collect()
    assert len(got) == 40 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


@pytest.mark.parametrize("dim,leaf", [(2, 1), (2, 8), (64, 8), (1, 3)])
def test_cover_tree_covers_and_separates(dim, leaf):
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.integers(-500, 500, (300, dim)), np.repeat(rng.integers(-500, 500, (1, dim)), 90, 0)])
    order, t = dual_tree_kmeans.cover_tree(x, leaf)
    assert sorted(order.tolist()) == list(range(390))
    y = x[order].astype(float)
    for i in range(len(t.lo)):
        rows = range(t.lo[i], t.hi[i])
        assert all(np.linalg.norm(y[r] - y[t.center[i]]) <= t.radius[i] + 1e-6 for r in rows)
        if t.children[i]:
            kids = range(t.child[i], t.child[i] + t.children[i])
            assert [r for c in kids for r in range(t.lo[c], t.hi[c])] == list(rows)
            reach = 2.0 ** (math.ceil(math.log2(t.radius[i] / (1 + dual_tree_kmeans.SLACK)) - 1e-12) - 1)
            assert all(np.linalg.norm(y[t.center[a]] - y[t.center[b]]) > reach for a, b in itertools.combinations(kids, 2))
            assert all(t.radius[c] <= reach * (1 + 1e-6) for c in kids)


def test_pruning_spares_most_rows(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(4000 * i, 60, (250, 3)) for i in range(8)]).astype(np.int64)
    order, tree = dual_tree_kmeans.cover_tree(x)
    cents = [[4000 * i] * 3 for i in range(8)]
    lo, hi, number = dual_tree_kmeans.assign(x[order], tree, dual_tree_kmeans.centroid_tree(cents))
    assert len(lo) < 100 and (hi - lo).sum() == 2000  # whole nodes, not rows
    label = np.repeat(number, hi - lo)[np.argsort(np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]))]
    assert (label == np.square(x[order][:, None] - np.array(cents)[None]).sum(2).argmin(1)).all()


DOCS = "doc_id long, text string, source string, n long, mask string, part string, total string"


def brute_audit(docs, labels):
    names = "ABCDE"
    texts = [(i, t or "", s or "") for i, t, s in docs]
    lab = lambda i, at: any(r[0] == i and r[at] == 1 for r in labels) if i is not None else False
    rows = []
    for i, t, s in texts:
        w = [x for x in "".join(c if c not in " \t\n\r\x0b\x0c" else " " for c in t).split(" ") if x]
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": any(j is not None and i is not None and j < i and u == t for j, u, _ in texts),
        }
        rows.append((s, {f for f in names if fails[f]}, lab(i, 1), lab(i, 2)))
    out = {}
    for part in {s for s, *_ in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(names, 0)
        for order in itertools.permutations(names):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in mine)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_applying_every_order(spark):
    rng = random.Random(6)
    docs = []
    for i in range(120):
        kind = rng.randint(0, 6)
        words = [rng.choice("abcdefgh") if kind == 1 else f"w{rng.randint(0, 9999)}" for _ in range(rng.choice([49, 50, 51, 3]))]
        text = rng.choice([" ", "\t", "\x0b", "\n"]).join(words) + rng.choice(["", " é x", " #", " ABCDEFGHIJ" * 3])
        docs.append((i, text, rng.choice(["s1", "s2", None, ""])))
    docs += [(200 + i, docs[i % 5][1], "s3") for i in range(60)] + [(300, None, "s1"), (301, "", "s1"), (302, None, None), (None, docs[0][1], "s1"), (None, None, "s2")]
    docs += [docs[3], docs[3], (3, docs[4][1], "s2"), (400, "word " * 30_000, "s4"), (401, "word " * 30_000 + "x", "s4")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(0, 1, 0), (None, 1, 1)]
    d = spark.createDataFrame([(i, t, s, 1, "", "", "") for i, t, s in docs], DOCS).repartition(3)
    got = filter_audit.filter_interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(spark.createDataFrame([], DOCS), labels).count() == 0
