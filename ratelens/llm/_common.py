"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: The same over UTF-8, whose longer characters hold none of these bytes.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: A-Z to a-z and nothing else.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

T = TypeVar("T", str | None, bytes | None)

#: Bound of a batch between the JVM and Python. Whole texts are large rows: a count of rows would bound nothing.
BATCH_BYTES = "4m"

_made: list[tuple[str, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one local JVM (tests), a temporary folder is set for the
    session; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.ratelens.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ratelens-")
        spark.conf.set("spark.ratelens.shared.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on at most ``BATCH_BYTES`` of this session's rows go to Python at once (or one row)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/ratelens-{name}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext.applicationId, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives a lost executor, as the files belong to no executor.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that the block has written, but for those it hands to the given function, at its end.

    Nothing that leaves the block may read a deleted table, so what is handed over must be a written one. Inside the block
    Spark removes the shuffle files of an action when it ends, as what is read again has been written as a table.
    """
    first, kept = len(_made), []
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(f.rpartition("/")[0] for f in df.inputFiles()[:1])
        return df

    try:
        yield keep
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
        for app, path in _made[first:]:
            if path not in kept and not any(path.rpartition("/")[2] in k for k in kept):
                _delete(spark, path)
                _made.remove((app, path))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written; nothing may read them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0].rpartition("/")[2]
            for app, path in [m for m in _made if m[1].rpartition("/")[2] == folder]:
                _delete(df.sparkSession, path)
                _made.remove((app, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Hand a worker's free memory back to the system at the end of a task, as idle workers stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def cleanup(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application; results read from them end with it."""
    gone = 0
    for app, path in list(_made):
        if app == spark.sparkContext.applicationId:
            _delete(spark, path)
            _made.remove((app, path))
            gone += 1
    return gone


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_BYTE_MARKS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Stable 64-bit hashes of all words of the texts in order, and the number of words of each text.

    A word's hash is the mixed sum of a mark of each byte times an odd factor of its place, computed
    for all bytes at once.
    """
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    raw = b" ".join([t or b"" for t in texts])
    a = np.frombuffer(raw.translate(ASCII_LOWER) if lower else raw, np.uint8)
    solid = _SOLID[a]
    if not solid.any():
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    dense = a[solid]
    at = np.flatnonzero(first[solid])
    lengths = np.diff(np.append(at, len(dense)))
    places = mix64(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    terms = _BYTE_MARKS[dense]
    terms *= places[np.arange(len(dense)) - np.repeat(at, lengths)]
    ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return mix64(np.add.reduceat(terms, at) + lengths.astype(np.uint64)), counts


def count_words(texts: list[bytes | None]) -> np.ndarray:
    """The number of words of each text."""
    solid = _SOLID[np.frombuffer(b" ".join([t or b"" for t in texts]), np.uint8)]
    starts = np.flatnonzero(solid & ~np.append(False, solid[:-1])) if len(solid) else np.empty(0, np.int64)
    return np.diff(np.searchsorted(starts, np.cumsum([len(t or b"") + 1 for t in texts])), prepend=0)


def gram_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; empty if there are fewer words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix64(out + word_hashes[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def shingle_set(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one has none."""
    if not len(word_hashes):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes, min(size, len(word_hashes))))


def runs(values: Iterable[T], limit: int = 1_000_000) -> Iterable[tuple[int, list[T]]]:
    """Cut a batch of texts into runs of about ``limit`` characters or bytes, with the first index of each."""
    start, size, held = 0, 0, []
    for i, text in enumerate(values):
        held.append(text)
        size += len(text or "")
        if size >= limit:
            yield start, held
            start, size, held = i + 1, 0, []
    if held:
        yield start, held


#: Key sets of at most this many rows (tens of MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: At most this many keys count as hot: each has more than a ``HOT_KEYS``-th of all rows.
HOT_KEYS, HOT_ROWS = 2_000, 200


def keys_for_join(keys: DataFrame, n: int | None = None) -> DataFrame:
    """``keys`` with a broadcast hint if their counted size allows it."""
    return F.broadcast(keys) if (keys.count() if n is None else n) <= BROADCAST_KEYS else keys


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one narrow row a key, without a task for all rows of a hot key.

    ``n`` is the number of rows. A key with more than ``max(HOT_ROWS, n / HOT_KEYS)`` of them is hot, so there are
    at most ``HOT_KEYS`` hot keys whatever the size of the table: their facts are broadcast, and their rows stay
    where they are. All others meet by a shuffle. Both tables are read twice, so they should be written ones.
    """
    if n <= HOT_ROWS:
        return rows.join(facts, keys, how)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max(HOT_ROWS, n // HOT_KEYS)).drop("_rows")
    hot = materialize(hot, "hot")
    if hot.isEmpty():
        return rows.join(facts, keys, how)
    # The rows pass the few hot keys' facts once: those of a hot key are told by the mark, whether they have a fact or not.
    own = facts.join(F.broadcast(hot), keys).withColumn("_known", F.lit(True))
    known = hot.join(F.broadcast(own), keys, "left").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(known), keys, "left")
    spread = marked.where("_hot") if how == "left" else marked.where("_hot and _known")
    cold = marked.where("_hot is null").select(*rows.columns).join(facts, keys, how)
    return cold.unionByName(spread.select(*cold.columns))


def text_hashes(text: Column) -> list[Column]:
    """``h1, h2``: two hashes of a text, null for a null one."""
    return [F.when(text.isNotNull(), F.xxhash64(F.lit(seed), text)).alias(name) for name, seed in (("h1", 1), ("h2", 3))]


def without_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``gone`` (doc_id, h1, h2: text hashes) doesn't name; nulls are equal to nulls."""
    keys = ["doc_id", "h1", "h2"]
    gone = materialize(gone.select(*(F.col(k).alias(f"_gone_{k}") for k in keys)).distinct(), "gone")
    hashes = text_hashes(F.col("text").cast("string"))
    marked = docs.withColumns({"_own_doc_id": F.col("doc_id"), "_own_h1": hashes[0], "_own_h2": hashes[1]})
    same = [F.col(f"_own_{k}").eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
    return marked.join(keys_for_join(gone), same, "left_anti").select(*docs.columns)


#: Surrogates of texts whose id another text has as well begin here, beyond all ids.
SURROGATE = 1 << 62


def surrogates(marks: DataFrame) -> DataFrame:
    """``doc_id, h1, node`` for texts (doc_id, h1: a hash of the text) that share their id with a different one.

    The text of the smallest hash keeps the id as its node, the others get a node of their own, so that
    operators on pairs never mix up two texts. Usually an empty table.
    """
    several = marks.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high")
    rows = marks.select("doc_id", "h1").join(several.select("doc_id", "low"), "doc_id").where("h1 <> low").distinct()
    return rows.withColumn("node", F.lit(SURROGATE) + F.shiftrightunsigned(F.xxhash64("doc_id", "h1"), 2))
