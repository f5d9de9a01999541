"""Embeddings as exact integer vectors inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each component x becomes floor(SCALE * x).
SCALE = 1024
#: Squared integer norms stay below this, so that products and squared distances of two vectors fit into 64 bits.
NORM_LIMIT = float(1 << 60)


def vector_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, embedding`` and nothing else, ids as long and components as double."""
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))


def integer_vectors(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors (one row each) of a batch (vec_id, embedding), for each length that occurs.

    Vectors that are null, hold a null or non-finite component, or whose squared norm reaches ``NORM_LIMIT`` are left out.
    """
    ids, vectors = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    held = np.maximum(sizes, 0)
    starts = np.cumsum(held) - held
    whole = sizes >= 0
    whole[np.repeat(np.arange(len(sizes)), held)[~np.isfinite(flat)]] = False
    for size in np.unique(sizes[whole]).tolist():
        rows = np.flatnonzero(whole & (sizes == size))
        with np.errstate(over="ignore"):
            scaled = np.floor(SCALE * flat[starts[rows, None] + np.arange(size)])
            fits = np.square(scaled).sum(1) < NORM_LIMIT
        if fits.any():
            yield ids.take(pa.array(rows[fits])), scaled[fits].astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers in 32 bits if all of them fit."""
    return x.astype(np.int32) if not x.size or max(-int(x.min()), int(x.max())) < 1 << 31 else x


def widen(raw: bytes, rows: int, cols: int) -> np.ndarray:
    """What ``narrow(x).tobytes()`` held, as 64-bit integers."""
    kind = np.int32 if len(raw) == 4 * rows * cols else np.int64
    return np.frombuffer(raw, kind).reshape(rows, cols).astype(np.int64)
