"""Stored tables that later runs and other queries read: a shared folder, partitions, replacement by partition."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ratelens.plans.config import SPLIT_SEEDS

_SETTING = "spark.ratelens.store.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one local JVM (tests, bench), a temporary one is made for the session; on a
    cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ratelens-store-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def store_path(spark: SparkSession, name: str, *key: object) -> str:
    """Where a stored table of this name and key lies; the same key gives the same place in every run."""
    mark = hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/ratelens-{name}-{mark}"


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Write the partitions that ``df`` has rows of, in place of what they held; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The stored table, or none of its rows where nothing has been written yet."""
    reader = spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def is_stored(spark: SparkSession, path: str, schema: T.StructType | str, seed: int) -> bool:
    """Whether the stored table has rows of a split."""
    return not read_partitions(spark, path, schema).where(F.col("split_seed") == seed).isEmpty()


def by_split(spark: SparkSession, path: str, schema: str, made: Callable[[int], DataFrame], splits: Sequence[int] = SPLIT_SEEDS) -> DataFrame:
    """One table of all splits, partitioned by ``split_seed``: what is stored is read, what is missing is made and stored.

    A filter on ``split_seed`` prunes partitions, so one split can be read without the others.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]
    for seed in splits:
        if not is_stored(spark, path, schema, seed):
            replace_partitions(made(seed).withColumn("split_seed", F.lit(seed)).select(*names), path, ("split_seed",))
    return read_partitions(spark, path, schema)
