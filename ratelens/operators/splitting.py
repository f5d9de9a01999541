"""Leak-free grouped splits, folds, exact stratified samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.rng import order_key
from ratelens.plans.config import COCHRAN_E, COCHRAN_P, COCHRAN_Z, MIN_PER_SEVERE_BIN, SEVERE_BINS

PARTS = ("train", "val", "test")


def majority_label(df: DataFrame, text: str = "review_text") -> DataFrame:
    """The most frequent rating of every text, the lowest of equally frequent ones."""
    counts = df.where(F.col(text).isNotNull()).groupBy(F.col(text), "rating").agg(F.count("*").alias("n"))
    return counts.groupBy(text).agg(F.min_by("rating", F.struct((-F.col("n")).alias("m"), "rating")).alias("majority"), F.sum("n").alias("n_rows"))


def grouped_split(df: DataFrame, seed: int, test: float = 0.20, val: float = 0.10, text: str = "review_text") -> DataFrame:
    """``text, majority, part``: every text lies in one part, each majority rating split in proportion.

    In each stratum texts are ordered by a hash; the first share is for training, the next for
    validation and the rest for testing, as two nested cuts do.
    """
    groups = majority_label(df, text)
    order = Window.partitionBy("majority").orderBy(order_key(seed, F.md5(text)), text)
    n = F.count("*").over(Window.partitionBy("majority"))
    placed = groups.select(text, "majority", "n_rows", F.row_number().over(order).alias("nth"), n.alias("n"))
    train = F.rint(F.col("n") * (1 - test - val))
    held = F.col("n") - train
    part = F.when(F.col("nth") <= train, "train").when(F.col("nth") <= train + F.rint(held * val / (test + val)), "val").otherwise("test")
    return placed.select(text, "majority", "n_rows", part.alias("part"))


def split_rows(df: DataFrame, parts: DataFrame, text: str = "review_text") -> DataFrame:
    return df.join(parts.select(text, "part"), text)


def split_summary(rows: DataFrame, text: str = "review_text") -> DataFrame:
    """Per part: rows, share, rows of repeated texts, and the share of each rating."""
    marked = rows.withColumn("repeats", F.count("*").over(Window.partitionBy(text)))
    shares = [F.round(F.avg((F.col("rating") == r).cast("double")), 6).alias(f"share_{r}") for r in range(1, 6)]
    per = marked.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("repeats") > 1).alias("n_repeated"), *shares)
    return per.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def overlaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``key, part_a, part_b, n``: values of each key that two parts share, from one aggregation a key."""
    found = None
    for key in keys:
        sets = rows.groupBy(F.col(key)).agg(*(F.max((F.col("part") == p).cast("int")).alias(p) for p in PARTS))
        pairs = [(a, b) for i, a in enumerate(PARTS) for b in PARTS[i + 1 :]]
        row = sets.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs))
        long = row.select(F.explode(F.array(*(F.struct(F.lit(key).alias("key"), F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), F.col(f"{a}_{b}").alias("n")) for a, b in pairs))).alias("x")).select("x.*")
        found = long if found is None else found.unionByName(long)
    return found


def stratified_kfold(df: DataFrame, k: int, seed: int, label: str = "rating", key: str = "review_id", deal: str | None = None) -> DataFrame:
    """Adds ``fold`` from 0 to k - 1; each label is dealt evenly, starting at another fold. ``deal`` names a column for
    the round in which a row was dealt, from 0: parts of rounds are stratified too, within any set of folds."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy(order_key(seed, F.col(key)), key)) - 1
    ranked = df.withColumn("_nth", nth)
    out = ranked.withColumn("fold", ((F.col("_nth") + F.col(label)) % k).cast("int"))
    return (out.withColumn(deal, F.floor(F.col("_nth") / k).cast("int")) if deal else out).drop("_nth")


def inner_holdout(folds: DataFrame, k: int, seed: int, share: float = 0.1, label: str = "rating", key: str = "review_id") -> DataFrame:
    """``outer, key, is_calibration``: for every fold its training rows, a stratified share held out."""
    outer = folds.withColumn("outer", F.explode(F.array(*(F.lit(i) for i in range(k))))).where("outer <> fold")
    by = Window.partitionBy("outer", label)
    nth = F.row_number().over(by.orderBy(order_key(seed, F.col("outer"), F.col(key)), key))
    return outer.select("outer", key, label, (nth <= F.rint(F.count("*").over(by) * share)).alias("is_calibration"))


def exact_sample(df: DataFrame, n: Column | int, seed: int, by: Sequence[str] = (), key: str = "review_id") -> DataFrame:
    """Exactly ``n`` rows (or all there are) of every stratum, by the order of a hash."""
    order = Window.partitionBy(*by).orderBy(order_key(seed, F.col(key)), key)
    limit = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("nth")


def proportional_sample(df: DataFrame, n: int, seed: int, by: str, key: str = "review_id") -> DataFrame:
    """Exactly ``n`` rows, spread over strata in proportion by largest remainders (the lower stratum of equal ones)."""
    sizes = df.groupBy(by).agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    share = sizes.withColumn("exact", F.lit(float(n)) * F.col("size") / total).withColumn("base", F.floor("exact"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), by))
    quota = share.select(by, (F.col("base") + (rank <= left).cast("long")).alias("quota"))
    return exact_sample(df.join(F.broadcast(quota), by), F.col("quota"), seed, (by,), key).drop("quota")  # a row per stratum


def cochran_n(population: int, e: float = COCHRAN_E, z: float = COCHRAN_Z, p: float = COCHRAN_P) -> dict[str, float]:
    n0 = z * z * p * (1 - p) / (e * e)
    return {"N": population, "n0": n0, "n": math.ceil(n0 / (1 + (n0 - 1) / population))} if population else {"N": 0, "n0": n0, "n": 0}


def cochran_columns(population: Column, e: float = COCHRAN_E, z: float = COCHRAN_Z, p: float = COCHRAN_P) -> tuple[Column, Column]:
    n0 = F.lit(z * z * p * (1 - p) / (e * e))
    return n0, F.ceil(n0 / (1.0 + (n0 - 1.0) / population)).cast("long")


def allocation(pools: Mapping[int, int], n: int = 100, least: int = MIN_PER_SEVERE_BIN, severe: Sequence[int] = SEVERE_BINS) -> dict[int, int]:
    """Rows to draw by distance: up to ``least`` of each severe one, the rest at distance 1."""
    take = {b: min(least, pools.get(b, 0)) for b in severe}
    return take | {1: min(max(n - sum(take.values()), 0), pools.get(1, 0))}


def allocation_plan(df: DataFrame, n: int = 100, least: int = MIN_PER_SEVERE_BIN) -> DataFrame:
    """``bin, pool, take, shortfall`` for distances 1 to 4 (larger ones count as 4)."""
    spark = df.sparkSession
    bins = spark.range(1, 5).select(F.col("id").cast("int").alias("bin"))
    pools = df.groupBy(F.least("rating_diff", F.lit(4)).alias("bin")).agg(F.count("*").alias("pool"))
    all_ = bins.join(pools, "bin", "left").select("bin", F.coalesce("pool", F.lit(0)).alias("pool"))
    severe = F.when(F.col("bin") > 1, F.least(F.lit(least), F.col("pool")))
    wanted = F.when(F.col("bin") > 1, F.lit(least)).otherwise(F.greatest(F.lit(n) - F.sum(severe).over(Window.partitionBy()), F.lit(0)))
    sized = all_.withColumn("wanted", wanted.cast("long"))
    return sized.select("bin", "pool", F.least("wanted", "pool").alias("take"), F.greatest(F.col("wanted") - F.col("pool"), F.lit(0)).alias("shortfall"))


def human_sample(df: DataFrame, n: int = 100, seed: int = 42, key: str = "review_id") -> DataFrame:
    """The rows to validate, drawn by the allocation, shuffled: ``draw`` is their blind order."""
    plan = allocation_plan(df, n).select("bin", "take")
    drawn = exact_sample(df.withColumn("bin", F.least("rating_diff", F.lit(4))).join(F.broadcast(plan), "bin"), F.col("take"), seed, ("bin",), key)
    order = Window.orderBy(order_key(seed + 1, F.col(key)), key)  # at most n rows
    return drawn.withColumn("draw", F.row_number().over(order)).drop("take")


def subset_size(n: int, share: float) -> int:
    """Rows of a second annotator or a retest: at least one, halves rounded to even."""
    return max(1, round(n * share))
