"""Operators of a training-data pipeline. Nothing outside this package imports it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("chat_format", "packing", "decontaminate", "substring_dedup", "near_dedup", "url_filter", "warc", "language_id", "quality_rules", "quality_classifier", "topk_search", "dual_tree_kmeans", "filter_audit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"ratelens.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"ratelens.llm.{m}").ORACLES.items()}
