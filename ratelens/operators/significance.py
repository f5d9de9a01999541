"""Comparing scenarios: results table, paired tests, shared resamples, consistency over splits.

The long prediction table is turned once into a wide one, a row per review, so that all hypotheses
and metrics are computed from a single resample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.ordinal import metrics
from ratelens.operators.resampling import BUCKETS, ErrorGap, Kappa, Statistic, resampled_sums  # noqa: F401
from ratelens.plans.config import ALPHA, BOOT_SEED, HYPOTHESES, NUM_CLASSES, SCENARIOS, WEIGHT_SEEDS

NAMES = tuple(s["name"] for s in SCENARIOS)


def unit(scenario: str, seed: int) -> str:
    return f"p_{scenario.split('_')[0]}_{seed}"


def ensemble(scenario: str) -> str:
    return f"e_{scenario.split('_')[0]}"


def error(scenario: str) -> str:
    return f"x_{scenario.split('_')[0]}"


def metrics_by_unit(long: DataFrame) -> DataFrame:
    return long.groupBy("scenario", "weight_seed").agg(F.count("*").alias("n"), *metrics(F.col("y_true"), F.col("y_pred")))


def results_table(long: DataFrame) -> DataFrame:
    """Mean and population deviation of every metric over the weight seeds."""
    per = metrics_by_unit(long)
    names = ("mae", "rmse", "accuracy", "off_by_one", "qwk")
    both = [f(F.col(m)).alias(f"{m}_{s}") for m in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    rounded = [F.round(f"{m}_{s}", 9).alias(f"{m}_{s}") for m in names for s in ("mean", "std")]
    return per.groupBy("scenario").agg(F.count("*").alias("n_seeds"), *both).select("scenario", "n_seeds", *rounded).orderBy("mae_mean")


#: Labels in a word of bits: a prediction is as many bits from the lowest on, so that the larger of two is their union.
IN_WORD = 63 // NUM_CLASSES


def wide_predictions(long: DataFrame, scenarios: Sequence[str] = NAMES, seeds: Sequence[int] = WEIGHT_SEEDS) -> DataFrame:
    """``review_id, y`` and per scenario each seed's prediction, their ensemble and mean absolute error.

    Predictions (1 to 5, or null) travel as bits of a few words, not as a column each. A column ``draw_bucket``, a function of the
    review, is kept: rows that are dealt by it are not moved here.
    """
    units = [(s, w) for s in scenarios for w in seeds]
    p, spread = F.col("y_pred"), 2**NUM_CLASSES - 1
    known = F.get(F.array(*(F.lit(2 ** (i + 1) - 1) for i in range(NUM_CLASSES))), p.cast("int") - 1)
    bits = F.when(p.isNull(), 0).otherwise(F.coalesce(known, F.raise_error(F.lit(f"y_pred has labels beyond 1 to {NUM_CLASSES}")).cast("int")))
    rows, words = long.withColumn("_bits", bits.cast("long")), []
    for at in range(0, len(units), IN_WORD):
        word = F.lit(0).cast("long")
        for i, (s, w) in reversed(list(enumerate(units[at : at + IN_WORD]))):
            word = F.when((F.col("scenario") == s) & (F.col("weight_seed") == w), F.shiftleft("_bits", NUM_CLASSES * i)).otherwise(word)
        words.append(F.bit_or(word).alias(f"_w{at // IN_WORD}"))
    keys = [c for c in ("draw_bucket", "review_id") if c in long.columns]
    packed = rows.groupBy(*keys).agg(F.max("y_true").alias("y"), *words)
    cell = lambda i: F.bit_count(F.shiftright(f"_w{i // IN_WORD}", NUM_CLASSES * (i % IN_WORD)).bitwiseAND(F.lit(spread)))
    wide = packed.select(*keys, "y", *(F.nullif(cell(i), F.lit(0)).alias(unit(s, w)) for i, (s, w) in enumerate(units)))
    extra = {}
    for s in scenarios:
        own = [F.col(unit(s, w)) for w in seeds]
        total, err = own[0], F.abs(own[0] - F.col("y"))
        for c in own[1:]:
            total, err = total + c, err + F.abs(c - F.col("y"))
        extra[ensemble(s)] = F.least(F.greatest(F.rint(total / len(seeds)), F.lit(1)), F.lit(5)).cast("int")
        extra[error(s)] = err / len(seeds)
    return wide.withColumns(extra)


def alignment(long: DataFrame, truth: DataFrame) -> DataFrame:
    """Per unit: reviews missing from it, unknown to the truth, with another label; all must be 0."""
    units = long.select("scenario", "weight_seed").distinct()
    want = units.crossJoin(truth.select(F.col("review_id").cast("string").alias("id"), F.col("y_true").alias("want")))  # truth for each unit: a row per expected prediction
    have = long.select("scenario", "weight_seed", F.col("review_id").cast("string").alias("id"), F.col("y_true").alias("have"))
    both = want.join(have, ["scenario", "weight_seed", "id"], "full_outer")
    return both.groupBy("scenario", "weight_seed").agg(
        F.count_if(F.col("have").isNull()).alias("n_missing"),
        F.count_if(F.col("want").isNull()).alias("n_unknown"),
        F.count_if(F.col("want") != F.col("have")).alias("n_other_label"),
    )


def paired_differences(wide: DataFrame) -> DataFrame:
    """``hypothesis, d, n``: the histogram of error differences (model a less model b)."""
    rows = F.array(*(F.struct(F.lit(name).alias("hypothesis"), F.round(F.col(error(a)) - F.col(error(b)), 9).alias("d")) for name, a, b in HYPOTHESES))
    return wide.select(F.explode(rows).alias("x")).select("x.*").groupBy("hypothesis", "d").agg(F.count("*").alias("n"))


def wilcoxon(differences: DataFrame) -> DataFrame:
    """Signed-rank statistic and z with zeros ranked and split between the sides.

    Ranks follow from the histogram of absolute differences; no row-level sort is needed.
    """
    size = differences.groupBy("hypothesis", F.abs("d").alias("a")).agg(
        F.sum("n").cast("double").alias("t"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("n"))), F.lit(0)).cast("double").alias("up"), F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("n"))), F.lit(0)).cast("double").alias("zero")
    )
    below = F.sum("t").over(Window.partitionBy("hypothesis").orderBy("a"))
    ranked = size.withColumn("rank", below - F.col("t") + (F.col("t") + 1) / 2)
    n = F.sum("t")
    sums = ranked.groupBy("hypothesis").agg(n.cast("long").alias("n"), (F.sum(F.col("up") * F.col("rank")) + F.sum(F.col("zero") * F.col("rank")) / 2).alias("r_plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    m = F.col("n").cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48
    return sums.select("hypothesis", "n", "r_plus", F.round((F.col("r_plus") - m * (m + 1) / 4) / F.nullif(F.sqrt(var), F.lit(0.0)), 9).alias("z"))


# Coefficients of Chebyshev's approximation of the complementary error function, relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """Normal tail on both sides; 1 where z is undefined, as all differences are then zero."""
    x = F.abs(z) / 2**0.5
    t = 1.0 / (1.0 + 0.5 * x)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = F.lit(c) + t * power
    return F.when(z.isNull() | F.isnan(z), 1.0).otherwise(F.least(t * F.exp(-x * x + power), F.lit(1.0)))


def holm(df: DataFrame, p: str = "p", by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Step-down adjustment: ``p_holm`` and whether it lies below ``alpha``."""
    order = Window.partitionBy(*by).orderBy(p, "hypothesis")
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(order) + 1) * F.col(p))
    adjusted = df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return adjusted.drop("_step").withColumn("significant", F.col("p_holm") <= alpha)


def significance_table(wide: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(name).alias("hypothesis"), F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(error(a)).alias("ea"), F.col(error(b)).alias("eb")) for name, a, b in HYPOTHESES))
    means = wide.select(F.explode(pairs).alias("x")).select("x.*").groupBy("hypothesis", "model_a", "model_b").agg(F.avg("ea").alias("mean_error_a"), F.avg("eb").alias("mean_error_b"))
    tested = wilcoxon(paired_differences(wide)).withColumn("p", two_sided_p(F.col("z")))
    return means.join(holm(tested), "hypothesis")


def _interval(boot: DataFrame, value: str, by: Sequence[str] = ("hypothesis",)) -> DataFrame:
    q = boot.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select(*by, F.round(F.col("q")[0], 9).alias("ci_low"), F.round(F.col("q")[1], 9).alias("ci_high"))


def _kappa(column: str) -> Kappa:
    return Kappa(f"k_{column}", "y", column)


def _mae_gap(a: str, b: str, seeds: Sequence[int]) -> list[tuple[float, Statistic]]:
    return [(1.0, ErrorGap(f"g_{a}_{b}", "y", tuple(unit(a, w) for w in seeds), tuple(unit(b, w) for w in seeds)))]


def _ensemble_gap(a: str, b: str, seeds: Sequence[int]) -> list[tuple[float, Statistic]]:
    return [(1.0, _kappa(ensemble(a))), (-1.0, _kappa(ensemble(b)))]


def _seed_gap(a: str, b: str, seeds: Sequence[int]) -> list[tuple[float, Statistic]]:
    return [x for w in seeds for x in ((1.0 / len(seeds), _kappa(unit(a, w))), (-1.0 / len(seeds), _kappa(unit(b, w))))]


#: A metric's difference of two models as a weighted sum of statistics.
GAPS = {"MAE": _mae_gap, "QWK_ensemble": _ensemble_gap, "QWK_per_seed": _seed_gap}


def _weighed(parts: Sequence[tuple[float, Statistic]]) -> Column:
    """The sum of the parts: those of one weight are added first, so that a mean is a sum divided once."""
    scale = abs(parts[0][0])
    signed = [x.value if w > 0 else -x.value for w, x in parts]
    pairs = [signed[i] + signed[i + 1] for i in range(0, len(signed), 2)] if len(signed) > 1 else signed
    total = pairs[0]
    for c in pairs[1:]:
        total = total + c
    return total if scale == 1.0 else total / len(pairs)


def effects(wide: DataFrame, n_boot: int, metrics: Sequence[str] = tuple(GAPS), seed: int = BOOT_SEED, seeds: Sequence[int] = WEIGHT_SEEDS, by: str | None = None) -> DataFrame:
    """``hypothesis, metric, diff, ci_low, ci_high``: differences of the two models with percentile intervals.

    All hypotheses and metrics share the draws, which are made once; a draw is n rows by hashed positions. With ``by``, each of that
    column's values is a table of its own, and its rows have the value.
    """
    found = {(name, m): GAPS[m](a, b, seeds) for m in metrics for name, a, b in HYPOTHESES}
    statistics = list(dict.fromkeys(x for parts in found.values() for _, x in parts))
    used = list(dict.fromkeys(c for x in statistics for c in ((x.y, x.p) if isinstance(x, Kappa) else (x.y, *x.a, *x.b))))
    sums, own = resampled_sums(wide, n_boot, used, statistics, seed, by=by), [by] if by else []
    rows = F.array(*(F.struct(F.lit(name).alias("hypothesis"), F.lit(m).alias("metric"), _weighed(parts).alias("diff")) for (name, m), parts in found.items()))
    long = sums.select(*own, "rep", F.explode(rows).alias("x")).select(*own, "rep", "x.*")
    point = long.where("rep < 0").select(*own, "hypothesis", "metric", F.round("diff", 9).alias("diff"))
    return point.join(_interval(long.where("rep >= 0"), "diff", (*own, "hypothesis", "metric")), [*own, "hypothesis", "metric"])


def mae_effects(wide: DataFrame, n_boot: int, seed: int = BOOT_SEED) -> DataFrame:
    """Mean error difference of every hypothesis with a percentile interval."""
    return effects(wide, n_boot, ("MAE",), seed).drop("metric")


def qwk_ensemble_effects(wide: DataFrame, n_boot: int, seed: int = BOOT_SEED) -> DataFrame:
    return effects(wide, n_boot, ("QWK_ensemble",), seed).drop("metric")


def qwk_per_seed_effects(wide: DataFrame, n_boot: int, seed: int = BOOT_SEED, seeds: Sequence[int] = WEIGHT_SEEDS) -> DataFrame:
    """Kappa differences averaged over weight seeds; the same draws serve all of them."""
    return effects(wide, n_boot, ("QWK_per_seed",), seed, seeds).drop("metric")


def effect_table(wide: DataFrame, n_boot: int, split_seed: int, n_seeds: int = len(WEIGHT_SEEDS)) -> DataFrame:
    """Fifteen rows: five hypotheses by three metrics; test columns on MAE rows alone."""
    tests = significance_table(wide).select("hypothesis", F.lit("MAE").alias("metric"), F.round("z", 9).alias("z"), "p", "p_holm", "significant")
    out = effects(wide, n_boot).join(tests, ["hypothesis", "metric"], "left")
    return out.withColumns({"split_seed": F.lit(split_seed), "n_weight_seeds": F.lit(n_seeds)})


def turned(effects: DataFrame) -> DataFrame:
    """``hypothesis, metric, split_seed, e, lo, hi``: effects and intervals in which more than 0 favours model A."""
    flip = F.col("metric") == "MAE"
    return effects.select(
        "hypothesis",
        "metric",
        "split_seed",
        F.when(flip, -F.col("diff")).otherwise(F.col("diff")).alias("e"),
        F.when(flip, -F.col("ci_high")).otherwise(F.col("ci_low")).alias("lo"),
        F.when(flip, -F.col("ci_low")).otherwise(F.col("ci_high")).alias("hi"),
    )


def effects_by_split(effects: DataFrame, splits: Sequence[int]) -> DataFrame:
    """``hypothesis, metric`` and for each split ``effect, low, high``, turned; null where a split is missing."""
    at = lambda s, c: F.max(F.when(F.col("split_seed") == s, F.col(c)))
    named = (("effect", "e"), ("low", "lo"), ("high", "hi"))
    return turned(effects).groupBy("hypothesis", "metric").agg(*(at(s, c).alias(f"{n}_{s}") for s in splits for n, c in named))


def consistency(effects: DataFrame, expected: int = 3) -> DataFrame:
    """A verdict per hypothesis and metric over the splits.

    Effects are turned so that more than 0 favours model A (MAE differences change sign). Consistent:
    one direction without ties and at least two intervals that exclude 0; with fewer splits than
    expected there is no verdict.
    """
    e = turned(effects)
    e = e.withColumns({"way": F.when(F.col("e") > 0, "A").when(F.col("e") < 0, "B").otherwise("tie"), "excl": (F.col("lo") > 0) | (F.col("hi") < 0)})
    per = e.groupBy("hypothesis", "metric").agg(F.count("*").alias("n_splits"), F.min("way").alias("low"), F.max("way").alias("high"), F.count_if("excl").alias("n_excluding_zero"))
    same = (F.col("low") == F.col("high")) & (F.col("low") != "tie")
    verdict = F.when(F.col("n_splits") < expected, "not assessable").when(same & (F.col("n_excluding_zero") >= 2), "consistent").otherwise("not consistent")
    return per.select("hypothesis", "metric", "n_splits", same.alias("same_direction"), "n_excluding_zero", verdict.alias("verdict"), F.when(same, F.col("low")).otherwise("mixed").alias("direction"))


def pivot_by_split(tests: DataFrame, value: str, splits: Sequence[int]) -> DataFrame:
    """Side by side, never combined: one column a split."""
    return tests.groupBy("hypothesis").agg(*(F.max(F.when(F.col("split_seed") == s, F.col(value))).alias(f"{value}_{s}") for s in splits))


def best_epoch(log: DataFrame, by: Sequence[str] = ("unit",)) -> DataFrame:
    """Highest kappa, then lowest error, then the earliest epoch."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("qwk"), "mae", "epoch"))
    return log.withColumn("rank", rank).where("rank = 1").select(*by, "epoch", "qwk", "mae")


def early_stop(log: DataFrame, patience: int = 3, by: Sequence[str] = ("unit",)) -> DataFrame:
    """The epoch after which training stops: the first that ends ``patience`` epochs without a lower error."""
    order = Window.partitionBy(*by).orderBy("epoch")
    best = F.min("mae").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.withColumn("better", F.col("mae") < F.coalesce(best, F.lit(float("inf"))))
    marked = marked.withColumn("run", F.count_if("better").over(order))
    marked = marked.withColumn("streak", F.count("*").over(Window.partitionBy(*by, "run").orderBy("epoch")) - 1)
    stop = F.min(F.when(F.col("streak") >= patience, F.col("epoch")))
    return marked.groupBy(*by).agg(F.coalesce(stop, F.max("epoch")).alias("last_epoch"))
