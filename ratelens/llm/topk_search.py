"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are stored in blocks of vertical layout: one slab of values for each block of dimensions, with the mass (squared
norm) of every vector in it. A query goes through the slabs in the order of its own mass, adds up partial products
and, after every slab, drops all candidates whose product so far and remaining mass can't reach the k-th best; the rest
is compacted, so later slabs are read at the survivors only. Bounds are Cauchy-Schwarz over integers, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, release, small_batches, table
from ratelens.llm.vectors import integer_vectors, narrow, vector_rows, widen

#: Vectors of a stored block, dimensions of a slab, queries that meet a block at once.
BLOCK, SLAB, QUERIES_AT_ONCE = 4096, 8, 1024
#: Queries are copied to every cell of blocks; a cell has up to 64 blocks, and there are at least 32 cells if there are as many blocks.
CELL_BLOCKS, CELLS = 64, 32

BLOCK_SCHEMA = "dim int, n int, ids array<long>, slabs array<binary>, masses binary"
QUERY_SCHEMA = "query_id long, dim int, v binary"
HIT_SCHEMA = "query_id long, query_key long, vec_id long, score long"


def _slabs(dim: int) -> list[slice]:
    return [slice(i, min(i + SLAB, dim)) for i in range(0, dim, SLAB)]


def _block(ids: np.ndarray, x: np.ndarray) -> dict:
    slabs = _slabs(x.shape[1])
    masses = np.array([np.square(x[:, s]).sum(1) for s in slabs], np.int64).reshape(len(slabs), len(x))
    return {"dim": x.shape[1], "n": len(x), "ids": ids.tolist(), "slabs": [narrow(np.ascontiguousarray(x[:, s].T)).tobytes() for s in slabs], "masses": masses.tobytes()}


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    kind = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("slabs", pa.list_(pa.binary())), ("masses", pa.binary())])

    def put(dim: int, least: int) -> Iterator[pa.RecordBatch]:
        if sum(len(i) for i, _ in held[dim]) < least:
            return
        ids, x = (np.concatenate(part) for part in zip(*held[dim], strict=True))
        whole = len(ids) if least == 1 else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            yield pa.RecordBatch.from_pylist([_block(ids[at : at + BLOCK], x[at : at + BLOCK])], kind)
        held[dim] = [(ids[whole:], x[whole:])] if whole < len(ids) else []

    for batch in batches:
        for ids, x in integer_vectors(batch):
            held.setdefault(x.shape[1], []).append((ids.to_numpy(zero_copy_only=False).astype(np.int64), x))
            yield from put(x.shape[1], BLOCK)
    for dim in held:
        yield from put(dim, 1)
    release()


def vertical_blocks(vectors: DataFrame) -> DataFrame:
    """The stored layout of (vec_id, embedding): up to ``BLOCK`` vectors of one length a row. No shuffle takes place."""
    small_batches(vectors.sparkSession)
    made = vectors.where(F.col("vec_id").isNotNull()).mapInArrow(_to_blocks, BLOCK_SCHEMA)
    return materialize(made.withColumn("block", F.monotonically_increasing_id()), "vertical")


def _to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, x in integer_vectors(batch):
            raw = [row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(raw, pa.binary())], ["query_id", "dim", "v"])


def search_block(q: np.ndarray, own: int, ids: np.ndarray, slabs: list[np.ndarray], masses: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (scores, ids; at most k, the best first) after one more block; rows with the id ``own`` don't count."""
    scores, names = best
    parts = [q[s] for s in _slabs(len(q))]
    q_mass = np.array([int(np.square(p).sum()) for p in parts], np.int64)
    alive = np.flatnonzero(ids != own)
    rest_q, rest = int(q_mass.sum()), masses[:, alive].sum(0) if len(parts) else np.zeros(len(alive), np.int64)
    total = np.zeros(len(alive), np.int64)
    limit = int(scores[-1]) if len(scores) == k else None
    order = np.argsort(-q_mass, kind="stable").tolist()
    for nth, b in enumerate(order):
        if not len(alive):
            break
        total = total + parts[b] @ (slabs[b] if len(alive) == slabs[b].shape[1] else slabs[b][:, alive])
        rest = rest - masses[b][alive]
        rest_q -= int(q_mass[b])
        if nth == len(order) - 1:
            break
        reach = np.ceil(np.sqrt(float(rest_q)) * np.sqrt(rest.astype(np.float64)) * (1 + 1e-9)).astype(np.int64) + 1
        if len(total) >= k:
            sure = int(-np.partition(reach - total, k - 1)[k - 1])  # k candidates reach this in any case
            limit = sure if limit is None else max(limit, sure)
        if limit is not None:
            left = total + reach >= limit
            if not left.all():
                alive, total, rest = alive[left], total[left], rest[left]
    scores, names = np.concatenate([scores, total]), np.concatenate([names, ids[alive]])
    if len(scores) > 4 * k:  # ties at the k-th score stay
        cut = -np.partition(-scores, k - 1)[k - 1]
        scores, names = scores[scores >= cut], names[scores >= cut]
    first = np.lexsort((names, -scores))[:k]
    return scores[first], names[first]


def _searcher(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        now, members, best = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                q, key = (np.repeat(np.array([m[i] for m in members], np.int64), sizes) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (q, key, np.concatenate([n for _, n in best]), np.concatenate([s for s, _ in best]))], ["query_id", "query_key", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                dim, n = row["dim"], row["n"]
                if now != (dim, row["g"]):
                    yield from found()
                    now = (dim, row["g"])
                    members = [(m["query_id"], m["query_key"], np.frombuffer(m["v"], np.int64)) for m in row["members"]]
                    best = [none] * len(members)
                ids = np.array(row["ids"], np.int64)
                slabs = [widen(raw, s.stop - s.start, n) for raw, s in zip(row["slabs"], _slabs(dim), strict=True)]
                masses = np.frombuffer(row["masses"], np.int64).reshape(len(slabs), n)
                best = [search_block(v, own, ids, slabs, masses, b, k) for (own, _, v), b in zip(members, best, strict=True)]
        yield from found()
        release()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows with the greatest integer inner product for every row that ``is_query`` (over id and vector) marks.

    Returns ``query_id, rank, vec_id, score``: rank from 1, ties to the smaller id, all others if there are fewer than k.

    Queries meet all rows in blocks: groups of ``QUERIES_AT_ONCE`` queries are copied to each cell of blocks and joined
    on the cell, so rows move once, queries once a cell, and a task holds one group and one block. A cell returns at
    most k rows a query, of which Spark keeps the k best before and after the last shuffle.

    Vectors that are null or hold nulls or non-finite components take no part, nor do rows without an id and vectors
    whose squared integer norm is 2^60 or more (their products might not fit into a long). Vectors of different lengths
    don't meet; empty ones have the product 0 with one another. Rows of a query's own id are never its candidates; otherwise
    repeated rows count one by one. Equal vectors under one id are one query, different ones under one id are ranked separately.
    Other columns aren't read. An empty table gives no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = vector_rows(vectors, id_col, vec_col)
    blocks = vertical_blocks(rows)
    asked = rows.where(F.col("vec_id").isNotNull() & is_query).mapInArrow(_to_queries, QUERY_SCHEMA)
    asked = materialize(asked.withColumn("query_key", F.xxhash64("v")).dropDuplicates(["query_id", "dim", "v"]), "queries")
    n_groups = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    n_blocks = blocks.count()
    cells = max(1, min(n_blocks, max(CELLS, n_blocks // CELL_BLOCKS)))
    group = F.pmod(F.xxhash64("query_id", "query_key"), F.lit(n_groups)).alias("g")
    groups = asked.groupBy("dim", group).agg(F.collect_list(F.struct("query_id", "query_key", "v")).alias("members"))
    groups = groups.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    placed = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells).cast("long"))).drop("block")
    hits = groups.join(placed, ["dim", "cell"]).mapInArrow(_searcher(k), HIT_SCHEMA)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 10
"""

QUERIES = {"op11_topk_search": op11_topk_search}
ORACLES = {"op11_topk_search": OP11_SQL}
