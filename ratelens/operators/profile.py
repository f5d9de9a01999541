"""Data-quality profile of a review table: counts, spans, lengths, duplicates, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.rng import order_key
from ratelens.functions.text import SHORT_WORDS, word_count

RATINGS = (1, 2, 3, 4, 5)


def rating_distribution(df: DataFrame) -> DataFrame:
    counts = df.where("rating is not null").groupBy("rating").agg(F.count("*").alias("n"))
    return counts.select("rating", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


def rating_by_app(df: DataFrame) -> DataFrame:
    """One row per app, one column per rating, zeros where there is none."""
    return df.where("source_app is not null").groupBy("source_app").agg(*(F.count_if(F.col("rating") == r).alias(f"n_{r}") for r in RATINGS))


def date_span(df: DataFrame) -> DataFrame:
    day = F.unix_date("date")
    return df.where("date is not null").groupBy("source_app", "rating").agg(
        F.count("*").alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.round(F.median(day.cast("double")), 6).alias("median_day"),
        F.datediff(F.max("date"), F.min("date")).cast("long").alias("span_days"),
    )


def temporal_confound(df: DataFrame) -> DataFrame:
    """Per app: the rating with the longest and the shortest span (lowest of equal ones) and their difference."""
    spans = date_span(df)
    return spans.groupBy("source_app").agg(
        F.max_by("rating", F.struct("span_days", (-F.col("rating")).alias("r"))).alias("longest_rating"),
        F.min_by("rating", F.struct("span_days", "rating")).alias("shortest_rating"),
        (F.max("span_days") - F.min("span_days")).alias("difference_days"),
    )


def with_lengths(df: DataFrame, text: str = "review_text") -> DataFrame:
    n = word_count(F.col(text))
    return df.withColumns({"n_words": n, "n_chars": F.length(F.coalesce(F.col(text), F.lit("")))}).withColumn("is_short", F.col("n_words") <= SHORT_WORDS)


def describe_lengths(df: DataFrame) -> DataFrame:
    levels = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    value = F.col("n_words").cast("double")
    all_ = df.agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.percentile(value, F.array(*(F.lit(x) for x in levels))).alias("q"),
    )
    quantiles = [F.round(F.col("q")[i], 6).alias(f"p{int(100 * x)}") for i, x in enumerate(levels)]
    return all_.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", *quantiles)


def lengths_by_rating(df: DataFrame) -> DataFrame:
    value = F.col("n_words").cast("double")
    return df.where("rating is not null").groupBy("rating").agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.round(F.stddev_samp(value), 6).alias("std")
    )


def short_share(df: DataFrame) -> DataFrame:
    """Per rating the share of very short texts; null for a rating without any."""
    short = F.count_if("is_short")
    return df.where("rating is not null").groupBy("rating").agg(
        short.alias("n_short"), F.count("*").alias("n"), F.round(F.when(short > 0, 100.0 * short / F.count("*")), 6).alias("pct_short")
    )


def length_histogram(df: DataFrame, top: int = 100, bins: int = 50) -> DataFrame:
    """The data of the length figure: lengths clipped at ``top`` in equal bins."""
    at = F.least(F.floor(F.least(F.col("n_words"), F.lit(top)) * bins / top), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, text: str = "review_text") -> DataFrame:
    return df.where(F.col(text).isNotNull()).groupBy(F.col(text)).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(df: DataFrame, text: str = "review_text") -> DataFrame:
    """Groups, rows in them and their share, from one aggregation by text."""
    sizes = df.groupBy(F.col(text)).agg(F.count("*").alias("n"))
    repeated = (F.col("n") > 1) & F.col(text).isNotNull()
    rows = F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0))
    return sizes.agg(F.count_if(repeated).alias("n_groups"), rows.alias("n_rows"), F.round(100.0 * rows / F.sum("n"), 6).alias("pct_rows"))


def top_duplicates(df: DataFrame, top: int = 200, text: str = "review_text") -> DataFrame:
    return duplicate_groups(df, text).orderBy(F.desc("n"), text).limit(top)


def conflict_groups(df: DataFrame, text: str = "review_text") -> DataFrame:
    """Texts with more than one rating, and the spread of those."""
    low, high = F.min("rating"), F.max("rating")
    grouped = df.where(F.col(text).isNotNull()).groupBy(F.col(text)).agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"))
    return grouped.where("low < high").select(text, "n", (F.col("high") - F.col("low")).alias("spread"))


def conflict_spread(df: DataFrame, text: str = "review_text") -> DataFrame:
    return conflict_groups(df, text).groupBy("spread").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


def conflict_examples(df: DataFrame, each: int = 5, top: int = 40, text: str = "review_text") -> DataFrame:
    own = df.join(conflict_groups(df, text).select(text), text, "left_semi")
    nth = F.row_number().over(Window.partitionBy(text).orderBy("rating", "review_id"))
    return own.withColumn("nth", nth).where(F.col("nth") <= each).select(text, "rating", "review_id").orderBy(text, "rating", "review_id").limit(top)


def language_markers(df: DataFrame, marker: str = "undetected_short") -> DataFrame:
    hit = F.count_if(F.col("detected_lang") == marker)
    return df.groupBy("source_app").agg(F.count("*").alias("n"), hit.alias("n_marked"), F.round(100.0 * hit / F.count("*"), 6).alias("pct_marked"))


def naive_split_leak(df: DataFrame, test_size: float, seed: int, text: str = "review_text") -> DataFrame:
    """What a row-level stratified split would leak: test rows whose text is also in train."""
    order = Window.partitionBy("rating").orderBy(order_key(seed, F.col("review_id")), "review_id")
    n = F.count("*").over(Window.partitionBy("rating"))
    parted = df.where(F.col(text).isNotNull()).withColumn("is_test", F.row_number().over(order) <= F.rint(n * test_size))
    by_text = parted.groupBy(F.col(text)).agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"))
    leaked = F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("test"))), F.lit(0))
    total = F.sum("test")
    return by_text.agg(total.alias("n_test"), leaked.alias("n_leaked"), F.round(100.0 * leaked / total, 6).alias("pct_leaked"))


def row_set(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def summary(df: DataFrame, text: str = "review_text", short: int = 3) -> DataFrame:
    """The profile's one-row summary from one scan and one shuffle: rows, apps, ratings, dates, lengths, copies and conflicts.

    Rows are first added up by a digest of their text (map-side), with all that the summary needs of them, so copies and
    conflicts come from the same pass as the counts. Null texts have no length and are no copies.
    """
    words = word_count(F.col(text))
    known = F.col(text).isNotNull()
    digest = F.when(known, F.sha2(F.col(text), 256))
    stars = [F.count_if(F.col("rating") == r).alias(f"r{r}") for r in range(1, 6)]
    by_text = df.groupBy(digest.alias("digest"), F.when(~known, F.col("rating")).alias("_spread")).agg(
        F.count("*").alias("n"),
        F.collect_set("source_app").alias("apps"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.sum(F.when(known, words)).alias("words"),
        F.count_if(known & (words <= short)).alias("short"),
        *stars,
    )
    text_row, ratings = F.col("digest").isNotNull(), sum((F.col(f"r{r}") > 0).cast("int") for r in range(1, 6))
    total = F.sum("n")
    share = lambda c: F.round(100.0 * c / F.nullif(total, F.lit(0)), 6)
    return by_text.agg(
        total.alias("n_rows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("apps")))).cast("long").alias("n_apps"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.sum(F.when(~text_row, F.col("n")).otherwise(0)).alias("n_null_texts"),
        F.count_if(text_row).alias("n_texts"),
        F.round(F.sum("words") / F.sum(F.when(text_row, F.col("n"))), 6).alias("mean_words"),
        share(F.sum("short")).alias("pct_short"),
        F.count_if(text_row & (F.col("n") > 1)).alias("n_copy_groups"),
        F.sum(F.when(text_row & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("n_copy_rows"),
        F.count_if(text_row & (ratings > 1)).alias("n_conflict_groups"),
        *(share(F.sum(f"r{r}")).alias(f"pct_{r}") for r in range(1, 6)),
    )
