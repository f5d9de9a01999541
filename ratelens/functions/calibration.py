"""Class-probability arrays: decoding, cumulative probabilities, ordinal chains, calibration error."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, FLOOR = 10, 1e-8


def argmax(probs: Column) -> Column:
    """Index of the largest probability, from 0; the lowest of equal ones."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def scaled(values: Column) -> Column:
    """Divided by their sum; equal shares where that is 0."""
    share = lambda v, total: F.transform(v, lambda x: F.when(total > 0, x / total).otherwise(1.0 / F.size(v)))
    return let(values, lambda v: let(_sum(v), lambda total: share(v, total)))


def derived_cumulative(probs: Column, classes: int = 5) -> Column:
    """P(y > k) for k = 1 .. classes - 1 as tail sums."""
    return F.array(*(_sum(F.slice(probs, k + 1, classes - k)) for k in range(1, classes)))


def bin_index(p: Column, bins: int = BINS) -> Column:
    return F.least(F.greatest(F.floor(p * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def ece(df: DataFrame, prob: str, event: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Expected calibration error of (prob, event) rows: two partial aggregations, by bin and over bins."""
    binned = df.groupBy(*by, bin_index(F.col(prob), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(prob)).alias("mean_prob"), F.avg(F.col(event).cast("double")).alias("mean_event")
    )
    return binned.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_event") - F.col("mean_prob"))) / F.sum("n")).alias("ece"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def chain(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Ordinal chain: running products of the sigmoids of logits, P(y > k)."""
    parts = F.transform(logits, lambda z: sigmoid(z / temperature))
    # Each product is the one before times the next part, so that every part is evaluated once.
    none = F.array().cast("array<double>")
    return F.aggregate(parts, none, lambda q, v: F.concat(q, F.array(F.when(F.size(q) == 0, v).otherwise(F.element_at(q, F.greatest(F.size(q), F.lit(1))) * v))))


def chain_probs(q: Column, floor: float = FLOOR) -> Column:
    """Class probabilities of a chain: differences, floored, scaled to one."""
    def raw(q: Column) -> Column:
        upper, lower = F.concat(F.array(F.lit(1.0)), q), F.concat(q, F.array(F.lit(0.0)))
        return F.zip_with(upper, lower, lambda a, b: F.greatest(a - b, F.lit(floor)))

    return scaled(let(q, raw))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    return scaled(let(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp((z - top) / temperature))))


def rank_decode(q: Column) -> Column:
    """Label index of a chain: how many thresholds it exceeds with more than one half."""
    return F.size(F.filter(q, lambda x: x > 0.5))


def monotonicity(df: DataFrame, q: str, tolerance: float = 0.0) -> DataFrame:
    """Rows, rows with a rise along the thresholds, share without, largest rise."""
    steps = F.zip_with(F.slice(q, 2, F.size(q) - 1), F.slice(q, 1, F.size(q) - 1), lambda b, a: b - a)
    rises = df.select(steps.alias("steps"))
    bad = F.exists("steps", lambda s: s > tolerance)
    return rises.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.count_if(bad), F.lit(0)).alias("n_violating"),
        (1.0 - F.count_if(bad) / F.greatest(F.count("*"), F.lit(1))).alias("share_monotone"),
        F.max(F.array_max("steps")).alias("largest_rise"),
    )


def chain_gap(df: DataFrame, q: str, probs: str) -> DataFrame:
    gaps = df.select(F.explode(F.zip_with(F.col(q), derived_cumulative(F.col(probs)), lambda a, b: F.abs(a - b))).alias("gap"))
    return gaps.agg(F.max("gap").alias("gap_max"), F.avg("gap").alias("gap_mean"))
