"""Reviews that keep arriving: cleaned, first seen wins, written once a batch. An extension, not parity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratelens.functions.text import clean


def cleaned_stream(reviews: DataFrame, slang: Mapping[str, str] | None = None, late: str = "1 day") -> DataFrame:
    """``reviews`` (streaming, with ``review_id, review_text, ts``) without late and repeated ids."""
    seen = reviews.withWatermark("ts", late).dropDuplicatesWithinWatermark(["review_id"])
    return seen.withColumn("cleaned_text", clean(F.col("review_text"), slang)).where("cleaned_text <> ''")


def arrivals(reviews: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Reviews by app, rating and window of event time."""
    return reviews.withWatermark("ts", late).groupBy(F.window("ts", every), "source_app", "rating").agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so a batch that is run again is written once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
