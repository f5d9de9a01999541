"""Bounded, repeatable samples of labelled rows for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample_ids(rows: DataFrame, label: str, total: int, least: int) -> DataFrame:
    """``doc_id, label`` of about ``total`` rows, spread evenly over the labels, at least ``least`` each.

    Rows are taken by the order of a hash of their id. A first cut by a hash threshold from the counts
    leaves little more than wanted, so that the exact cut sorts a bounded number of rows whatever the
    size of the table. At most ``max(total, least * labels)`` rows are returned.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    each = max(least, total // max(1, len(counts)))
    spread = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000_000))
    near = F.lit(False)
    for value, n in counts.items():
        near = near | ((F.col(label) == F.lit(value)) & (spread <= min(1_000_000_000, int(2e9 * (each + 10) / n))))
    cut = rows.where(near).select("doc_id", label)
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id")
    return cut.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("doc_id", label)
