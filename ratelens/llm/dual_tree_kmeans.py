"""Exact Lloyd rounds by two trees.

Vectors are stored once in blocks, each with a cover tree whose nodes are ranges of the block. In every round a cover tree
over the centroids meets these trees: pairs of nodes are dropped by distance bounds, a node with one centroid left is
counted as a whole through prefix sums, and only what is left over in pairs of leaves is compared, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, release, small_batches, table
from ratelens.llm.vectors import integer_vectors, narrow, vector_rows, widen

#: Vectors of a block and of a leaf at most.
BLOCK, LEAF = 2048, 8
#: Bounds are given this much room, as they are floating point.
SLACK = 1e-9

TREE_FIELDS = (("center", np.int32), ("lo", np.int32), ("hi", np.int32), ("radius", np.float64), ("child", np.int32), ("children", np.int32))
BLOCK_SCHEMA = "n int, ids array<long>, x binary, " + ", ".join(f"{name} binary" for name, _ in TREE_FIELDS)


@dataclass
class Tree:
    """Node i covers the rows lo[i] to hi[i] in tree order, all within radius[i] of row center[i]; its children are consecutive nodes."""

    center: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The order of the rows of ``x`` in the tree, and the tree.

    A node covers a ball around one of its rows. Its children's centers lie more than the greatest power
    of two below its radius apart, and each covers what lies within that distance of its center: first the node's own center, then
    any row not yet covered. Nodes of at most ``leaf`` rows or of equal rows are leaves.
    """
    order = np.arange(len(x))
    f = x.astype(np.float64)
    first = np.sqrt(np.square(f - f[0]).sum(1)) if len(x) else np.empty(0)
    nodes = [[0, 0, len(x), 0.0, 0, 0]]
    todo = [(0, first)]  # a node and the distances of its rows to its center
    while todo:
        i, far = todo.pop()
        lo, hi = nodes[i][1], nodes[i][2]
        widest = float(far.max()) if len(far) else 0.0
        nodes[i][3] = widest * (1 + SLACK)
        if hi - lo <= leaf or widest == 0:
            continue
        reach = 2.0 ** (np.ceil(np.log2(widest)) - 1)  # below widest, so no child is like its parent
        rows, left, groups = order[lo:hi].copy(), np.arange(hi - lo), []
        at, near = nodes[i][0], far
        while len(left):
            covered = near <= reach
            groups.append((at, rows[left[covered]], near[covered]))
            left = left[~covered]
            if len(left):
                at = int(rows[left[0]])
                near = np.sqrt(np.square(f[rows[left]] - f[at]).sum(1))
        nodes[i][4:] = [len(nodes), len(groups)]
        for at, members, near in groups:
            order[lo : lo + len(members)] = members
            todo.append((len(nodes), near))
            nodes.append([at, lo, lo + len(members), 0.0, 0, 0])
            lo += len(members)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    columns = [np.array(c, kind) for c, (_, kind) in zip(zip(*nodes, strict=True), TREE_FIELDS, strict=True)]
    columns[0] = place[columns[0]].astype(np.int32) if len(x) else columns[0]
    return order, Tree(*columns)


@dataclass
class Centroids:
    """Distinct centroids in tree order with the smallest number of each."""

    x: np.ndarray
    numbers: np.ndarray
    tree: Tree


def centroid_tree(centroids: list[list[int]]) -> Centroids:
    first: dict[tuple[int, ...], int] = {}
    for number, c in enumerate(centroids):
        first.setdefault(tuple(c), number)
    x = np.array(list(first), np.int64)
    order, tree = cover_tree(x, leaf=1)
    return Centroids(x[order], np.array(list(first.values()), np.int64)[order], tree)


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of lo, lo + 1, ..., lo + size - 1 for each pair, one after another."""
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


def assign(x: np.ndarray, tree: Tree, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lo, hi, number``: disjoint ranges of rows, together all of them, with the nearest centroid's number (ties: the smallest)."""
    f, g = x.astype(np.float64), c.x.astype(np.float64)
    best = np.full(len(tree.lo), np.inf)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done, close = [], []
    while len(a):
        gap = np.sqrt(np.square(f[tree.center[a]] - g[c.tree.center[b]]).sum(1))
        np.minimum.at(best, a, gap + tree.radius[a])  # a node's center is a centroid, so no row has a farther nearest one
        open_ = gap - tree.radius[a] - c.tree.radius[b] <= best[a] * (1 + SLACK) + SLACK
        a, b = a[open_], b[open_]
        whole = (np.bincount(a, minlength=len(best))[a] == 1) & (c.tree.children[b] == 0)
        done.append((tree.lo[a[whole]], tree.hi[a[whole]], c.numbers[c.tree.center[b[whole]]]))
        a, b = a[~whole], b[~whole]
        # each node of vectors goes down itself, or all its centroid nodes do
        inner = c.tree.children[b] > 0
        split = np.zeros(len(best), bool)
        split[a[inner & ((tree.children[a] == 0) | (c.tree.radius[b] >= tree.radius[a]))]] = True
        ends = (tree.children[a] == 0) & ~split[a]
        close.append((a[ends], c.tree.center[b[ends]]))
        down = ~split[a] & ~ends
        sizes = np.where(down, tree.children[a], np.where(split[a] & inner, c.tree.children[b], np.where(ends, 0, 1)))
        step = _ranges(np.zeros(len(a), np.int64), sizes)
        pair = np.repeat(np.arange(len(a)), sizes)
        above = a[pair]
        a_next = np.where(down[pair], tree.child[above] + step, above)
        b_next = np.where(split[above] & inner[pair], c.tree.child[b[pair]] + step, b[pair])
        best[a_next] = np.minimum(best[a_next], best[above])
        a, b = a_next, b_next
    node, at = (np.concatenate(p) for p in zip(*close, strict=True))
    sizes = tree.hi[node] - tree.lo[node]
    row, at = _ranges(tree.lo[node], sizes), np.repeat(at, sizes)
    exact = np.empty(len(row), np.int64)
    for i in range(0, len(row), 8192):
        exact[i : i + 8192] = np.square(x[row[i : i + 8192]] - c.x[at[i : i + 8192]]).sum(1)
    order = np.lexsort((c.numbers[at], exact, row))
    row, number = row[order], c.numbers[at][order]
    top = np.append(True, row[1:] != row[:-1]) if len(row) else np.empty(0, bool)
    done.append((row[top], row[top] + 1, number[top]))
    return tuple(np.concatenate(p).astype(np.int64) for p in zip(*done, strict=True))


def _to_blocks(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), *((name, pa.binary()) for name, _ in TREE_FIELDS)])

    def made(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, tree = cover_tree(x)
        row = {"n": len(x), "ids": ids.take(pa.array(order)).to_pylist(), "x": narrow(x[order]).tobytes()}
        return pa.RecordBatch.from_pylist([row | {name: getattr(tree, name).tobytes() for name, _ in TREE_FIELDS}], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = pa.array([], pa.int64()), np.empty((0, dim), np.int64)
        for batch in batches:
            for more, y in integer_vectors(batch):
                if y.shape[1] == dim:
                    ids, x = pa.concat_arrays([ids, more]), np.concatenate([x, y])
                    whole = len(x) // BLOCK * BLOCK
                    for at in range(0, whole, BLOCK):
                        yield made(ids.slice(at, BLOCK), x[at : at + BLOCK])
                    ids, x = ids.slice(whole), x[whole:]
        if len(x):
            yield made(ids, x)
        release()

    return run


def tree_blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding) as stored blocks of up to ``BLOCK`` vectors with their cover trees. No shuffle takes place."""
    small_batches(vectors.sparkSession)
    return materialize(vectors.mapInArrow(_to_blocks(dim), BLOCK_SCHEMA), "cover-trees")


def _read(row: dict, dim: int) -> tuple[np.ndarray, Tree]:
    return widen(row["x"], row["n"], dim), Tree(*(np.frombuffer(row[name], kind) for name, kind in TREE_FIELDS))


def _summer(centroids: list[list[int]], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroid_tree(centroids)
        for batch in batches:
            for row in batch.to_pylist():
                x, tree = _read(row, dim)
                lo, hi, number = assign(x, tree, c)
                upto = np.zeros((len(x) + 1, dim), np.int64)
                np.cumsum(x, axis=0, out=upto[1:])
                n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
                np.add.at(n, number, hi - lo)
                np.add.at(sums, number, upto[hi] - upto[lo])
                yield pa.RecordBatch.from_pylist([{"cluster": k, "n": int(n[k]), "sums": sums[k].tolist()} for k in np.flatnonzero(n).tolist()], kind)

    return run


def _labeller(centroids: list[list[int]], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = centroid_tree(centroids), np.array(centroids, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x, tree = _read(row, dim)
                lo, hi, number = assign(x, tree, c)
                cluster = np.empty(len(x), np.int32)
                cluster[_ranges(lo, hi - lo)] = np.repeat(number, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(np.square(x - at[cluster]).sum(1))], ["vec_id", "cluster", "distance"])
        release()

    return run


def _starts(vectors: DataFrame, k: int, seed: int, dim: int) -> list[list[int]]:
    """The ``k`` usable vectors with the smallest SHA-256 of ``seed:id``; equal ids go by their vectors, rows without one come last."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in integer_vectors(batch):
                if x.shape[1] == dim:
                    marks = [None if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids.to_pylist()]
                    best = sorted(range(len(x)), key=lambda j: (marks[j] is None, marks[j] or "", x[j].tolist()))[:k]
                    yield pa.RecordBatch.from_pylist([{"mark": marks[j], "v": x[j].tolist()} for j in best], pa.schema([("mark", pa.string()), ("v", pa.list_(pa.int64()))]))

    found = vectors.mapInArrow(kept, "mark string, v array<long>")
    return [list(r.v) for r in found.orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()]


def lloyd(blocks: DataFrame, centroids: list[list[int]], rounds: int, dim: int) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over stored blocks; a round that changes nothing ends them.

    A block gives one row of sums a cluster, which Spark adds up; the driver sees one row a cluster.
    """
    for _ in range(rounds if centroids else 0):
        sums = blocks.mapInArrow(_summer(centroids, dim), "cluster int, n long, sums array<long>")
        total = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(dim))).alias("sums"))
        moved = {r.cluster: [int(s) // r.n for s in r.sums] for r in total.collect()}
        after = [moved.get(i, c) for i, c in enumerate(centroids)]
        if after == centroids:
            break
        centroids = after
    return centroids


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector with ``dim`` components.

    Vectors that are null, hold nulls or non-finite components or have another length take no part, nor do those whose squared
    integer norm is 2^60 or more, as their distances might not fit into a long; an inertia that doesn't fit is null. Rows
    without an id are clustered like others but start a cluster only if there are too few others. Repeated
    rows count one by one, and may start several clusters, of which the smallest number gets the vectors. Fewer
    than k vectors start as many clusters; an empty table gives no rows. Other columns aren't read.

    The driver holds ``k`` centroids; ``k`` is a bounded parameter. A task holds one block of ``BLOCK`` vectors with its tree.
    """
    rows = vector_rows(vectors, id_col, vec_col)
    blocks = tree_blocks(rows, dim)
    final = lloyd(blocks, _starts(rows, k, seed, dim), rounds, dim)
    spark = vectors.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(final)]
    marks = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    if not final:
        told = spark.createDataFrame([], "vec_id long, cluster int, distance long")
    else:
        told = materialize(blocks.mapInArrow(_labeller(final, dim), "vec_id long, cluster int, distance long"), "clusters")
    per = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    inertia = per.agg(F.sum("part").alias("whole"))  # k rows
    facts = per.join(F.broadcast(marks), "cluster").crossJoin(F.broadcast(inertia))  # k rows by one
    facts = facts.select("cluster", F.expr("try_cast(part AS bigint)").alias("cluster_inertia"), F.expr("try_cast(whole AS bigint)").alias("inertia"), "centroid_sha256")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def lloyd_sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    """All rounds, one after another, for DuckDB."""
    d = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, e FROM (SELECT e, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT v.vec_id, v.e, c.cluster, {d} AS d FROM v, c{i} c) GROUP BY vec_id)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT cluster, p, floor_div AS x FROM (SELECT cluster, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, {dim + 1})) AS p FROM a{i}) GROUP BY cluster, p))")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT cluster, list(x::BIGINT ORDER BY p) AS e FROM s{i} GROUP BY cluster) n ON n.cluster = c.cluster)")
    last = (
        f"SELECT a.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 "
        f"FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"
    )
    return "WITH " + ",\n".join(steps) + "\n" + last


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLES = {"op12_centroid_clusters": lloyd_sql()}
