"""All queries of the engine's own operators and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratelens.plans import q_labels, q_reviews, q_runs, q_statistics

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (q_reviews, q_labels, q_statistics, q_runs)
QUERIES: dict[str, Query] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
