"""Evaluation of proxies: a wide row for each, the ablation of all four, and sensitivity to the number of folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions import calibration as cal
from ratelens.functions.ordinal import metrics
from ratelens.operators import confident, models
from ratelens.operators.oof_store import Provider
from ratelens.operators.resampling import Kappa, resampled_sums
from ratelens.plans.config import BOOT_SEED, CV_FOLDS, K_VALUES, NUM_CLASSES


def _thresholds(rows: DataFrame, q: Column) -> DataFrame:
    return rows.select("rating", F.posexplode(q).alias("at", "q")).select("q", (F.col("at") + 1).alias("k"), (F.col("rating") > F.col("at") + 1).alias("event"))


def _mean_ece(rows: DataFrame, q: Column, name: str) -> DataFrame:
    return cal.ece(_thresholds(rows, q), "q", "event", ("k",)).agg(F.round(F.avg("ece"), 9).alias(name))


def evaluate(detected: DataFrame, counts: Mapping[str, object], chain: bool = False) -> DataFrame:
    """One row: what is known about the proxy, its metrics, flagged share and calibration report.

    ``detected`` are rows of ``confident.detect``; the chain's columns exist where there is one.
    """
    y, p = F.col("rating"), F.col("predicted_rating")
    known = [(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in counts.items()]
    row = detected.agg(F.count("*").alias("n_train"), *metrics(y, p), F.round(100.0 * F.count_if("is_noise") / F.count("*"), 6).alias("pct_flagged")).select(*known, "*")
    tail = cal.derived_cumulative(F.col("probs"))
    parts = [
        cal.ece(detected.select(F.array_max("probs").alias("p"), (y == p).alias("ok")), "p", "ok").agg(F.round(F.max("ece"), 9).alias("ece_top_label")),
        _mean_ece(detected, tail, "ece_derived_mean"),
    ]
    if chain:
        parts += [
            _mean_ece(detected, F.col("q_chain"), "ece_chain_mean"),
            cal.monotonicity(detected, "q_chain").select(F.col("n_violating").alias("chain_n_violating"), F.round("largest_rise", 9).alias("chain_largest_rise")),
            cal.chain_gap(detected, "q_chain", "probs").select(F.round("gap_max", 9).alias("chain_gap_max"), F.round("gap_mean", 9).alias("chain_gap_mean")),
        ]
    return reduce(DataFrame.crossJoin, parts, row)  # one row each


def _typed(counts: Mapping[str, object]) -> dict[str, Column]:
    return {n: F.lit(v).cast("string" if n == "selected_method" else "long") for n, v in counts.items()}


def _fit(df: DataFrame, proxy_id: int, k: int) -> tuple[DataFrame, dict[int, float]]:
    return models.proxy_oof(df, proxy_id, k, NUM_CLASSES)


def evaluate_proxy(df: DataFrame, proxy_id: int, k: int = CV_FOLDS, provider: Provider = _fit) -> tuple[DataFrame, DataFrame]:
    """The evaluation row of a proxy over ``review_id, rating, embedding``, and its rows with their flags.

    ``provider`` gives the out-of-fold rows: fitted here, or ``OofStore.get``, which fits only what isn't stored.
    """
    oof, temperatures = provider(df.withColumn("label", F.col("rating") - 1), proxy_id, k)
    detected, counts = confident.detect_with_counts(oof)
    mean = sum(temperatures.values()) / len(temperatures) if temperatures else None
    label, name = models.PROXIES[proxy_id]
    known = {"proxy_id": proxy_id, "label": label, "name": name, "k": k, **_typed(counts), "mean_temperature": F.lit(mean).cast("double")}
    return evaluate(detected, known, proxy_id == models.FINAL_PROXY), detected


def proxy_ablation(df: DataFrame, proxies: Sequence[int] = tuple(models.PROXIES), provider: Provider = _fit) -> DataFrame:
    """The evaluation rows of P1 to P4; columns that a proxy lacks are null."""
    return confident.ablation_table([evaluate_proxy(df, i, provider=provider)[0] for i in proxies])


def predictions_by_k(df: DataFrame, ks: Sequence[int] = K_VALUES, provider: Provider = _fit) -> dict[int, DataFrame]:
    """Out-of-fold rows of the final proxy for every number of folds."""
    labelled = df.withColumn("label", F.col("rating") - 1)
    return {k: provider(labelled, models.FINAL_PROXY, k)[0] for k in ks}


def k_table(oof: Mapping[int, DataFrame], base: int = CV_FOLDS) -> DataFrame:
    """A row for each number of folds: metrics, calibration, counts, and the similarity of its flags to those of ``base``."""
    found = {k: confident.detect_with_counts(rows) for k, rows in oof.items()}
    rows = []
    for k, (detected, counts) in sorted(found.items()):
        same = confident.jaccard(detected.where("is_noise"), found[base][0].where("is_noise")).select(F.col("jaccard").alias("jaccard_vs_base"))
        flagged = detected.agg(F.count_if("is_noise").alias("n_flagged"))
        rows.append(evaluate(detected, {"k": k, **_typed(counts)}, chain=True).crossJoin(flagged).crossJoin(same))  # one row each
    return reduce(DataFrame.unionByName, rows)


def paired_qwk(oof: Mapping[int, DataFrame], n_boot: int, seed: int = BOOT_SEED) -> DataFrame:
    """``k_x, k_y, qwk_diff, ci_low, ci_high, covers_zero`` for every pair of fold counts with ``k_x`` below ``k_y``.

    All fold counts share the draws. Kappas by draw are a row for each draw and fold count; the pairs are a join of these
    with themselves on the draw. A draw of one constant label has no kappa and is left out of the interval.
    """
    ks = sorted(oof)
    long = reduce(DataFrame.unionByName, (confident.with_predictions(oof[k]).select("review_id", "rating", F.lit(k).alias("k"), "predicted_rating") for k in ks))
    wide = long.groupBy("review_id").agg(F.max("rating").alias("y"), *(F.max(F.when(F.col("k") == k, F.col("predicted_rating"))).alias(f"p_{k}") for k in ks))
    statistics = {k: Kappa(f"k_{k}", "y", f"p_{k}") for k in ks}
    sums = resampled_sums(wide, n_boot, ["y", *(f"p_{k}" for k in ks)], list(statistics.values()), seed)
    flat = sums.select("rep", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), x.value.alias("qwk")) for k, x in statistics.items()))).alias("x")).select("rep", "x.*")
    x, y = flat.withColumnsRenamed({"k": "k_x", "qwk": "x"}), flat.withColumnsRenamed({"k": "k_y", "qwk": "y"})
    pairs = x.join(y, "rep").where("k_x < k_y").select("rep", "k_x", "k_y", (F.col("x") - F.col("y")).alias("diff"))
    point = pairs.where("rep < 0").drop("rep")
    ends = pairs.where("rep >= 0").groupBy("k_x", "k_y").agg(F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    both = point.join(ends, ["k_x", "k_y"])
    return both.select("k_x", "k_y", F.round("diff", 9).alias("qwk_diff"), F.round(lo, 9).alias("ci_low"), F.round(hi, 9).alias("ci_high"), ((lo <= 0) & (hi >= 0)).alias("covers_zero"))
