"""Connected components of an undirected edge table, without gathering any of it on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, split_join

#: Alternating stars need O(log^2 n) rounds; far more than that means the edges change while being read.
MAX_ROUNDS = 200
#: Edges of at most this number (some ten MB) are followed by one task, as rounds of jobs take longer than they do.
FEW_EDGES = 200_000
#: Steps of smaller tables are computed again where they are used twice, larger ones written.
WRITTEN = 5_000


def _stored(df: DataFrame, name: str, n: int) -> DataFrame:
    return materialize(df, name) if n > WRITTEN else df


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Larger neighbours of a node go to the least node near it; they stay where that is the node itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _stored(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), "low", n)
    moved = split_join(both.where("b > a"), low, ["a"], n, "left")
    return moved.select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = _stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "down", n)
    low = _stored(down.groupBy("a").agg(F.min("b").alias("m")), "low", n)
    moved = split_join(down, low, ["a"], n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: each node has one smaller one, which has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    ups = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    bad = (F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))
    row = ups.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if(bad)).first()
    return row[0], not row[1]


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, comp`` of all edges of one task: roots are the smallest nodes of their trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (a, b): comp is the smallest node it can reach.

    Alternating large and small stars; minima are partial aggregates, and a hub's edges meet its minimum
    by a broadcast of the few hubs, so a node with very many edges needs no task of its own. Loops and
    repeated edges don't matter; an empty table gives no rows. Every round is written to the shared
    folder. At most ``FEW_EDGES`` distinct edges are followed in one task instead.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges = materialize(down.distinct(), "edges")
    if edges.count() <= FEW_EDGES:
        return edges.coalesce(1).mapInArrow(_followed, "node long, comp long")
    for _ in range(MAX_ROUNDS):
        n, stars = _state(edges)
        if stars:
            break
        edges = materialize(_small_star(_large_star(edges, n), n).where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct())
