"""Row draws of a wide table, n_boot times n of them, counted where they are drawn.

A draw is a hash of seed, draw and block, so that SQL can draw the same rows; n_boot times n of them are made by definition.
But they are never rows of a table: the labels of a row fit into a few bits, so a task holds packed labels and draws, and
returns the sums of each draw alone. Nothing is shuffled for them. Packed labels are broadcast in chunks of bounded size;
with several chunks every chunk's tasks draw again and keep what falls into theirs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.rng import h
from ratelens.operators.lineage import _fs
from ratelens.plans.config import BOOT_SEED, NUM_CLASSES
from ratelens.sources.store import shared_dir

#: Rows are numbered bucket by bucket, in the order of their ids; a bucket is packed by one task.
BUCKETS = 64
#: Packed labels of a chunk at most (or one bucket), counts that a task holds, and rows summed at once.
CHUNK_BYTES, COUNTS, BLOCK = 160_000_000, 128_000_000, 1 << 16
#: Messages hashed at once, so that the work stays in the cache.
PIECE = 1 << 14

_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Kappa(NamedTuple):
    """Sums for the quadratic kappa of two labels, over the rows that have both."""

    name: str
    y: str
    p: str

    @property
    def sums(self) -> list[str]:
        return [f"{self.name}_{s}" for s in ("n", "off", "yy", "pp", "y", "p")]

    @property
    def value(self) -> Column:
        n, off, yy, pp, y, p = (F.col(c).cast("double") for c in self.sums)
        return 1.0 - off / F.nullif(yy + pp - 2.0 * y * p / n, F.lit(0.0))

    def terms(self, labels: dict[str, np.ndarray]) -> list[np.ndarray]:
        y, p = labels[self.y], labels[self.p]
        ok = (y > 0) & (p > 0)
        y, p = y * ok, p * ok
        return [ok, (y - p) * (y - p), y * y, p * p, y, p]


class ErrorGap(NamedTuple):
    """Sums for the mean difference of two models' absolute errors, each averaged over its predictions."""

    name: str
    y: str
    a: tuple[str, ...]
    b: tuple[str, ...]

    @property
    def sums(self) -> list[str]:
        return [f"{self.name}_n", f"{self.name}_gap"]

    @property
    def value(self) -> Column:
        n, gap = (F.col(c).cast("double") for c in self.sums)
        return gap / (n * len(self.a) * len(self.b))

    def terms(self, labels: dict[str, np.ndarray]) -> list[np.ndarray]:
        y = labels[self.y]
        ok = reduce(np.logical_and, (labels[c] > 0 for c in (*self.a, *self.b)), y > 0)
        off = lambda names: sum(np.abs(labels[c] - y) for c in names)
        return [ok, (off(self.a) * len(self.b) - off(self.b) * len(self.a)) * ok]


Statistic = Kappa | ErrorGap


def md5_words(prefix: bytes, first: int, count: int) -> np.ndarray:
    """The MD5 of ``prefix`` and each of ``count`` numbers from ``first`` on, as four little-endian words (4, count).

    All numbers must have the same number of digits, and the message at most 55 bytes.
    """
    digits = len(str(first))
    size = len(prefix) + digits
    raw = bytearray(64)
    raw[: len(prefix)], raw[size], raw[56:64] = prefix, 0x80, (8 * size).to_bytes(8, "little")
    words: list = [int.from_bytes(raw[4 * i : 4 * i + 4], "little") for i in range(16)]
    rest = np.arange(first, first + count, dtype=np.int64)
    for at in range(size - 1, len(prefix) - 1, -1):
        rest, digit = rest // 10, (rest % 10 + 48).astype(np.uint32)
        words[at // 4] = np.bitwise_or(words[at // 4], digit << np.uint32(8 * (at % 4)), dtype=np.uint32)
    a, b, c, d = (np.full(count, v, np.uint32) for v in _START)
    f, t = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(64):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(words[at], int):
            f += np.uint32((words[at] + _ADDED[i]) & 0xFFFFFFFF)
        else:
            f += words[at]
            f += np.uint32(_ADDED[i])
        by = _TURNS[turn, i % 4]
        np.left_shift(f, by, out=t)
        np.right_shift(f, np.uint32(32) - by, out=f)
        np.bitwise_or(t, f, out=t)
        t += b
        a, b, c, d, t = d, t, b, c, a
    return np.stack([v + np.uint32(s) for v, s in zip((a, b, c, d), _START, strict=True)])


def shared_positions(seed: int, rep: int, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of a draw in tables of several sizes, piece by piece, as (which, positions): a digest gives four of them,
    each 32 of its bits times the size, and is made once for all tables."""
    blocks, at = max(-(-n // 4) for n in sizes), 0
    while at < blocks:
        count = min(PIECE, blocks - at, 10 ** len(str(at)) - at)
        four = md5_words(f"{seed}|{rep}|".encode(), at, count).byteswap().T.ravel() / 2.0**32
        for k, n in enumerate(sizes):
            if 4 * at < n:
                yield k, np.floor(four[: n - 4 * at] * n).astype(np.int64)
        at += count


def positions(seed: int, rep: int, n: int) -> Iterator[np.ndarray]:
    """The n positions of a draw, piece by piece."""
    return (p for _, p in shared_positions(seed, rep, (n,)))


def bucket_of(review_id: Column) -> Column:
    return h("bucket", review_id) % BUCKETS


def _packed(columns: Sequence[str], classes: int) -> tuple[list[Column], int, int]:
    """The words that hold the labels of a row, the bits of a label, and the labels in a word; 0 is a missing one."""
    bits = classes.bit_length()
    per = 63 // bits
    label = lambda c: F.when(F.col(c).isNull(), 0).when(F.col(c).between(1, 2**bits - 1), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has labels beyond 1 to {2**bits - 1}")).cast("int"))
    words = [columns[i : i + per] for i in range(0, len(columns), per)]
    shifted = lambda w: reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(label(c).cast("long"), bits * i) for i, c in enumerate(w)))
    return [shifted(w).alias(f"w{j}") for j, w in enumerate(words)], bits, per


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("review_id")
    words = np.stack([rows[c].to_numpy() for c in rows.column_names if c not in ("part", "bucket", "review_id")])
    return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "bucket": pa.array([rows["bucket"][0].as_py()], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})


def packed_buckets(wide: DataFrame, columns: Sequence[str], classes: int, by: str | None = None) -> DataFrame:
    """``part, bucket, n, words``: the packed labels of each bucket. Rows that are dealt by ``draw_bucket`` already are not moved again."""
    bucket = F.col("draw_bucket") if "draw_bucket" in wide.columns else bucket_of(F.col("review_id"))
    part = (F.lit(0) if by is None else F.col(by)).cast("int")
    placed = wide.select(part.alias("part"), bucket.alias("bucket"), "review_id", *_packed(columns, classes)[0])
    return placed.groupBy("part", "bucket").applyInArrow(_pack, "part int, bucket long, n long, words binary")


def _drawer(spans: dict[int, tuple[int, int]], n_boot: int, groups: int, seed: int, columns: Sequence[str], bits: int, per: int, statistics: Sequence[Statistic]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``spans`` has each part's number of rows, and where in it the chunk's rows begin."""
    names = [s for x in statistics for s in x.sums]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, dict[int, np.ndarray]] = {}
        group = None
        for batch in batches:
            for g, part, bucket, size, words in zip(*(batch.column(k) for k in range(5)), strict=True):
                group = g.as_py()
                buckets.setdefault(part.as_py(), {})[bucket.as_py()] = np.frombuffer(words.as_buffer(), np.int64).reshape(-1, size.as_py())
        if group is None:
            return
        parts = {}
        for part in sorted(buckets):
            own = buckets.pop(part)
            parts[part] = np.concatenate([own.pop(b) for b in sorted(own)], axis=1)
        pieces = [(*spans[part], words.shape[1]) for part, words in parts.items()]
        reps = list(range(group - 1, n_boot, groups))  # -1: the table as it is
        step = min(32, max(1, COUNTS // sum(rows for _, _, rows in pieces)))
        for i in range(0, len(reps), step):
            own = reps[i : i + step]
            drawn_of = list(zip(*(_shared_counts(r, pieces, seed) for r in own), strict=True))
            for (part, words), counts in zip(parts.items(), drawn_of, strict=True):
                sums = np.zeros((len(own), len(names)), np.int64)
                for at in range(0, words.shape[1], BLOCK):
                    block = words[:, at : at + BLOCK]
                    labels = {c: (block[j // per] >> (bits * (j % per)) & (2**bits - 1)).astype(np.float32) for j, c in enumerate(columns)}
                    terms = np.stack([t.astype(np.float32, copy=False) for x in statistics for t in x.terms(labels)])
                    drawn = np.stack([c[at : at + BLOCK] for c in counts]).astype(np.float32)
                    # Sums of integers below 2^24 are exact in either width.
                    wide = float(drawn.sum(1, dtype=np.float64).max()) * float(np.abs(terms).max()) >= 2**24
                    sums += np.rint(drawn.astype(np.float64) @ terms.astype(np.float64).T if wide else drawn @ terms.T).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64()), *(pa.array(sums[:, k]) for k in range(len(names)))], ["part", "rep", *names])

    return draw


def _shared_counts(rep: int, pieces: Sequence[tuple[int, int, int]], seed: int) -> list[np.ndarray]:
    """How often a draw takes each row of pieces (rows of the whole table, first row, rows) of several tables."""
    if rep < 0:
        return [np.ones(rows, np.uint8) for _, _, rows in pieces]
    found = [np.zeros(rows, np.uint32) for _, _, rows in pieces]
    for k, p in shared_positions(seed, rep, [n for n, _, _ in pieces]):  # counted piece by piece: the positions of a draw are never held at once
        n, start, rows = pieces[k]
        np.add.at(found[k], p if rows == n else p[(p >= start) & (p < start + rows)] - start, np.uint32(1))
    return [f.astype(np.uint8) if f.max() < 256 else f for f in found]


def _counts(rep: int, n: int, start: int, rows: int, seed: int) -> np.ndarray:
    """How often a draw takes each row of a chunk."""
    return _shared_counts(rep, [(n, start, rows)], seed)[0]


def resampled_sums(wide: DataFrame, n_boot: int, columns: Sequence[str], statistics: Sequence[Statistic], seed: int = BOOT_SEED, classes: int = NUM_CLASSES, by: str | None = None) -> DataFrame:
    """``rep`` and the sums of the statistics: the whole table at -1, then ``n_boot`` draws of n rows with replacement.

    ``columns`` are the labels (from 1 on, or null) that the statistics read. Row ``pos`` of a draw is that of the same place in
    the order of a hashed bucket and ``review_id``. All statistics share the draws. An empty table gives no rows.
    With ``by``, a column of small whole numbers, each of its values is a table of its own, and the digests of a draw are made once for all of them.
    """
    spark = wide.sparkSession
    words, bits, per = _packed(columns, classes)
    path = f"{shared_dir(spark)}/ratelens-draws-{uuid.uuid4().hex}"
    packed_buckets(wide, columns, classes, by).write.parquet(f"{path}/packed")
    packed = spark.read.parquet(f"{path}/packed")
    sizes = sorted((r["part"], r["bucket"], r["n"]) for r in packed.select("part", "bucket", "n").collect())  # a row a bucket
    chunks, before = [], {}
    for part, bucket, size in sizes:
        if not chunks or (chunks[-1]["rows"] + size) * 8 * len(words) > CHUNK_BYTES:
            chunks.append({"starts": {}, "rows": 0, "buckets": []})
        chunks[-1]["starts"].setdefault(part, before.get(part, 0))
        chunks[-1]["rows"] += size
        chunks[-1]["buckets"].append(part * BUCKETS + bucket)
        before[part] = before.get(part, 0) + size
    groups = max(1, min(n_boot + 1, 4 * spark.sparkContext.defaultParallelism))
    names = [s for x in statistics for s in x.sums]
    schema = ", ".join(["part int", "rep long", *(f"{c} long" for c in names)])
    parts = [spark.createDataFrame([], schema)]
    for chunk in chunks:
        few = F.broadcast(packed.where((F.col("part").cast("long") * BUCKETS + F.col("bucket")).isin(chunk["buckets"])))
        tasks = spark.range(0, groups, 1, groups).crossJoin(few)  # a task for each group of draws, all packed rows of the chunk
        parts.append(tasks.mapInArrow(_drawer({p: (before[p], start) for p, start in chunk["starts"].items()}, n_boot, groups, seed, columns, bits, per, statistics), schema))
    found = reduce(DataFrame.union, parts).groupBy("part", "rep").agg(*(F.sum(c).alias(c) for c in names))
    found = found.drop("part") if by is None else found.withColumnRenamed("part", by)
    found.write.parquet(f"{path}/sums")
    fs, p = _fs(spark, f"{path}/packed")
    fs.delete(p, True)
    return spark.read.parquet(f"{path}/sums")
