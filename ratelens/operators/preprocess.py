"""Cleaning a review table, duplicates and conflicting labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.text import SHORT_WORDS, clean, tokens, word_count


def clean_reviews(df: DataFrame, slang: Mapping[str, str] | None = None, elongation: bool = True) -> DataFrame:
    """Drops null texts, cleans, drops blank results and flags very short ones; no shuffle takes place.

    The cleaned text is exploded from an array that is empty for a blank one: a filter on a projection would make
    the optimiser compute the whole chain twice.
    """
    once = F.filter(F.array(clean(F.col("review_text"), slang, elongation)), lambda t: t != "")
    cleaned = df.where("review_text is not null").select(*df.columns, F.explode(once).alias("cleaned_text"))
    kept = cleaned.withColumn("n_words", word_count(F.col("cleaned_text")))
    return kept.withColumn("is_very_short", F.col("n_words") <= SHORT_WORDS)


def first_of_text_and_rating(df: DataFrame, text: str = "cleaned_text", order: str = "review_id") -> DataFrame:
    """Pure duplicates go; the first in arrival order stays."""
    nth = F.row_number().over(Window.partitionBy(text, "rating").orderBy(order))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth")


def resolve_conflicts(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Of a text with several ratings only rows of its single most frequent one stay; a tie drops all.

    Texts with one rating keep all their rows.
    """
    digest = F.struct(F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text)), F.length(text))
    by_text = Window.partitionBy("_text")
    counted = df.withColumn("_text", digest).withColumn("_n", F.count("*").over(Window.partitionBy("_text", "rating")))
    # The rows are read and cleaned once; of a rating's rows the first stands for it.
    first = F.row_number().over(Window.partitionBy("_text", "rating").orderBy(F.lit(1))) == 1
    best = counted.withColumn("_first", first).withColumn("_most", F.max("_n").over(by_text))
    ties = F.sum(F.when(F.col("_first") & (F.col("_n") == F.col("_most")), 1).otherwise(0)).over(by_text)
    return best.withColumn("_ties", ties).where("_n = _most and _ties = 1").select(*df.columns)


def preprocess_summary(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows at each step; conflicts are counted before pure duplicates go."""
    texts = cleaned.groupBy("cleaned_text").agg(F.count("*").alias("n"), F.count_distinct("rating").alias("ratings"))
    facts = texts.agg(
        F.sum("n").alias("n_cleaned"),
        F.sum("ratings").alias("n_after_dedup"),
        F.count_if(F.col("ratings") > 1).alias("n_conflict_groups"),
        F.coalesce(F.sum(F.when(F.col("ratings") > 1, F.col("n"))), F.lit(0)).alias("n_conflict_rows"),
    )
    short = cleaned.agg(F.count_if("is_very_short").alias("n_very_short"))
    total = raw.agg(F.count("*").alias("n_raw"), F.count_if(F.col("review_text").isNull()).alias("n_null"))
    return total.crossJoin(facts).crossJoin(short)  # one row each


def slang_coverage(df: DataFrame, slang: Mapping[str, str], text: str = "review_text") -> DataFrame:
    """Share of lower-cased raw tokens, reduced to a-z and 0-9, that the lexicon knows."""
    known = F.array(*(F.lit(k) for k in slang)) if slang else F.array().cast("array<string>")
    bare = F.filter(F.transform(tokens(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")
    per = df.select(F.size(bare).alias("n"), F.size(F.filter(bare, lambda w: F.array_contains(known, w))).alias("hits"))
    total, hits = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))
    return per.agg(total.alias("n_tokens"), hits.alias("n_known"), F.round(F.when(total > 0, 100.0 * hits / total).otherwise(0.0), 6).alias("pct_known"))


def truncation(df: DataFrame, length: F.Column, most: int = 128) -> DataFrame:
    """Rows whose token count exceeds the model's limit, and the median count; ``length`` counts tokens."""
    counted = df.select(length.cast("double").alias("len"))
    return counted.agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("len") > most) / F.count("*"), 6).alias("pct_truncated"), F.floor(F.median("len")).cast("long").alias("median_len"))


def mark_languages(df: DataFrame, detect: F.Column, text: str = "review_text", language: str = "id") -> DataFrame:
    """Texts under three characters are kept and marked; others stay if the detector names the language."""
    short = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 3
    marked = df.withColumn("detected_lang", F.when(short, "undetected_short").otherwise(detect))
    return marked.where(F.col("detected_lang").isin("undetected_short", language))
