"""The corpus pipeline: rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage works on what its predecessor kept; all but the last return the columns of ``documents``, whatever further
ones there are. Rows are told by their id and text, so different texts under one id are documents of their own and
repeated rows share their fate; rows without an id have no duplicates. Null texts are empty ones and fail the first
stage, as do all texts of fewer than ten words. Texts of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, scratch, table, without_texts
from ratelens.llm.decontaminate import matched_texts
from ratelens.llm.near_dedup import text_components
from ratelens.llm.packing import pack_documents
from ratelens.llm.quality_rules import keep_by_ledger, stored_ledger
from ratelens.llm.substring_dedup import remove_passages, text_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the production policy go, by the stored ledger."""
    return keep_by_ledger(docs, stored_ledger(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return without_texts(docs, text_components(docs).where(~F.col("kept")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents left without a word go."""
    cut = remove_passages(docs, text_passages(docs))
    left = cut.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go."""
    return without_texts(docs, matched_texts(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("repeated passages", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the tokenizer of the last stage; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's own tables go with it
            docs = keep(materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
