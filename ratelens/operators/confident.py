"""Confident learning over out-of-fold class probabilities, and diagnostics of what it flags.

Input rows: ``review_id, rating`` (1 to 5) and ``probs`` (array of five). Thresholds, cells and cuts are
tables of five to sixty rows: they are read and become constants of the plan, so that flags need no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.calibration import argmax
from ratelens.plans.config import MIN_CLASS, NUM_CLASSES, SEVERITY

CLASSES = range(1, NUM_CLASSES + 1)


def with_predictions(df: DataFrame) -> DataFrame:
    predicted = argmax(F.col("probs")) + 1
    return df.withColumn("predicted_rating", predicted.cast("int")).withColumn("rating_diff", F.abs(F.col("rating") - F.col("predicted_rating")))


def thresholds(df: DataFrame) -> DataFrame:
    """``rating, threshold``: the mean probability of a class over the rows that carry it as a label."""
    own = F.element_at("probs", F.col("rating"))
    return df.groupBy("rating").agg(F.avg(own).alias("threshold"), F.count("*").alias("n"))


def once(df: DataFrame, column: str = "probs") -> DataFrame:
    """The same rows; what computes the column is evaluated once a row and not again wherever it is used."""
    return df.select(*(c for c in df.columns if c != column), F.explode(F.array(column)).alias(column))


def with_confident_class(df: DataFrame) -> DataFrame:
    """Adds ``confident``: the likeliest class of those at or above their threshold, null if none is.

    The five thresholds are read first and become part of the plan.
    """
    known = {r["rating"]: r["threshold"] for r in thresholds(df).collect()}
    limits = F.array(*(F.lit(known[j] if known.get(j) is not None else float("inf")) for j in CLASSES))
    passing = F.zip_with("probs", limits, lambda p, t: F.when(p >= t, p).otherwise(-1.0))
    best = F.array_max(passing)
    return once(df).withColumn("confident", F.when(best >= 0, F.array_position(passing, best).cast("int")))


def _cells(marked: DataFrame) -> list:
    """Rows by label, confident class and whether they are predicted as labelled: at most sixty, read in one pass."""
    return marked.groupBy("rating", "confident", (F.col("predicted_rating") != F.col("rating")).alias("wrong")).agg(F.count("*").alias("n")).collect()


def _joint(cells: list) -> dict[tuple[int, int], int]:
    out = {(i, j): 0 for i in CLASSES for j in CLASSES}
    for r in cells:
        if (r["rating"], r["confident"]) in out:
            out[r["rating"], r["confident"]] += r["n"]
    return out


def _calibrated(cells: list) -> dict[tuple[int, int], float | None]:
    """The joint scaled so that each label's row has as many rows as carry it, and all add up to n."""
    joint, sizes = _joint(cells), _sizes(cells)
    rows = {i: sum(joint[i, j] for j in CLASSES) for i in CLASSES}
    scaled = {(i, j): joint[i, j] * sizes.get(i, 0) / rows[i] if rows[i] else 0.0 for i, j in joint}
    total, n = sum(scaled.values()), sum(sizes.get(i, 0) for i in CLASSES)
    return {k: v * n / total if total else None for k, v in scaled.items()}


def _sizes(cells: list) -> dict[int, int]:
    out: dict[int, int] = {}
    for r in cells:
        out[r["rating"]] = out.get(r["rating"], 0) + r["n"]
    return out


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def confident_joint(df: DataFrame) -> DataFrame:
    """``rating, confident, n``: all 25 cells of rows with a confident class."""
    joint = _joint(_cells(with_predictions(with_confident_class(df))))
    return _table(df, [(*k, v) for k, v in joint.items()], "rating int, confident int, n long")


def calibrated_joint(df: DataFrame) -> DataFrame:
    """``rating, confident, n, calibrated``: the calibrated joint."""
    cells = _cells(with_predictions(with_confident_class(df)))
    joint, calibrated = _joint(cells), _calibrated(cells)
    return _table(df, [(*k, n, calibrated[k]) for k, n in joint.items()], "rating int, confident int, n long, calibrated double")


def _estimate(cells: list) -> int | None:
    off = [v for (i, j), v in _calibrated(cells).items() if i != j]
    return None if None in off else math.floor(sum(off))


def estimated_issues(df: DataFrame) -> DataFrame:
    """``estimated``: the mass off the diagonal of the calibrated joint."""
    return _table(df, [(_estimate(_cells(with_predictions(with_confident_class(df)))),)], "estimated long")


def _cuts(marked: DataFrame, cells: list) -> tuple[dict[tuple[int, int], tuple[float, object]], int]:
    """Per label and other class the margin and id of the last row within its quota, and the number of rows within any."""
    sizes = _sizes(cells)
    quotas = {k: round(v) for k, v in _calibrated(cells).items() if v is not None and k[0] != k[1] and sizes.get(k[0], 0) >= MIN_CLASS}
    quotas = {k: v for k, v in quotas.items() if v > 0}
    if not quotas:
        return {}, 0
    entry = F.array(*(F.struct(F.lit(i).alias("label"), F.lit(j).alias("other"), F.lit(q).cast("long").alias("quota")) for (i, j), q in quotas.items()))
    margins = marked.where("predicted_rating <> rating").select("review_id", "rating", "probs", F.explode(entry).alias("x")).where("x.label = rating")
    margins = margins.select("review_id", "rating", "x.other", "x.quota", (F.element_at("probs", F.col("x.other")) - F.element_at("probs", F.col("rating"))).alias("margin"))
    rank = F.row_number().over(Window.partitionBy("rating", "other").orderBy(F.desc("margin"), "review_id"))
    # The constant bound lets every task drop all rows beyond it before the shuffle.
    picked = margins.withColumn("rank", rank).where(F.col("rank") <= max(quotas.values())).where(F.col("rank") <= F.col("quota"))
    by_row = picked.groupBy("review_id").agg(F.collect_list(F.struct("rating", "other", "rank", "margin")).alias("hits"))
    last = F.max(F.struct("hit.rank", "hit.margin", "review_id")).alias("last")
    found = by_row.select("review_id", F.posexplode("hits").alias("at", "hit")).groupBy("hit.rating", "hit.other").agg(last, F.count_if(F.col("at") == 0).alias("rows")).collect()
    return {(r["rating"], r["other"]): (r["last"]["margin"], r["last"]["review_id"]) for r in found}, sum(r["rows"] for r in found)


def _flagged(df: DataFrame) -> tuple[DataFrame, list, int]:
    """Rows with both flags, the cells, and the number of rows that the second flags. Three small results are read before:
    thresholds, cells and cuts; the flags themselves are a projection."""
    marked = with_predictions(with_confident_class(df))
    cells = _cells(marked)
    cuts, pruned = _cuts(marked, cells)
    wrong = F.col("predicted_rating") != F.col("rating")
    by_joint = F.coalesce(F.col("confident") != F.col("rating"), F.lit(False)) & wrong
    limits = F.array(*(F.struct(F.lit(i).alias("label"), F.lit(j).alias("other"), F.lit(margin).alias("margin"), F.lit(last).alias("last")) for (i, j), (margin, last) in cuts.items()))

    def within(c: Column) -> Column:
        margin = F.element_at("probs", c["other"]) - F.element_at("probs", F.col("rating"))
        return (F.col("rating") == c["label"]) & ((margin > c["margin"]) | ((margin == c["margin"]) & (F.col("review_id") <= c["last"])))

    hit = F.exists(limits, within) if cuts else F.lit(False)
    return marked.withColumns({"confident_learning": by_joint, "prune_by_noise_rate": hit & wrong}).drop("confident"), cells, pruned


def flags(df: DataFrame) -> DataFrame:
    """Both filters for every row.

    ``confident_learning`` flags rows whose confident class is another one; ``prune_by_noise_rate``
    for every pair of label and class as many rows as the calibrated joint has, by the largest margin
    of the class over the label. Neither flags a row that is predicted as labelled, and labels of
    fewer than ``MIN_CLASS`` rows are left alone by the second.
    """
    return _flagged(df)[0]


def _by_joint(cells: list) -> int:
    return sum(r["n"] for r in cells if r["wrong"] and r["confident"] is not None and r["confident"] != r["rating"])


def _selected(cells: list, pruned: int) -> tuple[str, int, int | None]:
    """The method whose count is nearest to the estimate, the first of equally near ones."""
    counts, estimated = {"confident_learning": _by_joint(cells), "prune_by_noise_rate": pruned}, _estimate(cells)
    best = min(counts, key=lambda m: abs(counts[m] - (estimated or 0)))
    return best, counts[best], estimated


def select_method(df: DataFrame) -> DataFrame:
    """``selected, n_flagged, estimated``: the method nearest to the estimate."""
    _, cells, pruned = _flagged(df)
    return _table(df, [_selected(cells, pruned)], "selected string, n_flagged long, estimated long")


def detect_with_counts(df: DataFrame, threshold: int = SEVERITY) -> tuple[DataFrame, dict[str, object]]:
    """Rows with ``is_noise`` by the selected method and ``is_noise_severe``; and the counts that led to the method."""
    flagged, cells, pruned = _flagged(df)
    method, _, estimated = _selected(cells, pruned)
    noisy = flagged.withColumn("is_noise", F.col(method))
    counts = {"selected_method": method, "n_confident_learning": _by_joint(cells), "n_prune_by_noise_rate": pruned, "n_estimated": estimated}
    return noisy.withColumn("is_noise_severe", F.col("is_noise") & (F.col("rating_diff") >= threshold)), counts


def detect(df: DataFrame, threshold: int = SEVERITY) -> DataFrame:
    """Rows with ``is_noise`` by the selected method and ``is_noise_severe``."""
    return detect_with_counts(df, threshold)[0]


VARIANTS = ("raw", "hard", "severe")


def variant_filter(variant: str) -> Column:
    return {"raw": F.lit(True), "hard": ~F.col("is_noise"), "severe": ~F.col("is_noise_severe")}[variant]


def export_variants(resolved: DataFrame, columns: list[str], proxy: str = "P4", folds: int = 5) -> dict[str, DataFrame]:
    """Training variants of conflict-free rows; only the final proxy with five folds may export them."""
    if (proxy, folds) != ("P4", 5):
        raise ValueError(f"variants come from P4 with 5 folds, not from {proxy} with {folds}")
    return {v: resolved.where(variant_filter(v)).select(*columns) for v in VARIANTS}


def variant_counts(rows: DataFrame) -> DataFrame:
    counts = rows.agg(*(F.count_if(variant_filter(v)).alias(v) for v in VARIANTS))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("n")) for v in VARIANTS))).alias("x")).select("x.*")


def per_class_quality(df: DataFrame) -> DataFrame:
    """Recall, precision and error for all five classes; null where a class has no rows."""
    y, p = F.col("rating"), F.col("predicted_rating")
    rows = df.select(F.explode(F.array(F.struct(y.alias("c"), F.lit(1).alias("is_true"), (y == p).cast("int").alias("hit"), F.abs(y - p).alias("err")), F.struct(p.alias("c"), F.lit(0).alias("is_true"), F.lit(0).alias("hit"), F.lit(0).alias("err")))).alias("x")).select("x.*")
    per = rows.groupBy("c").agg(F.sum("is_true").alias("n_true"), F.sum(1 - F.col("is_true")).alias("n_predicted"), F.sum("hit").alias("tp"), F.sum("err").alias("err"))
    classes = df.sparkSession.range(1, NUM_CLASSES + 1).select(F.col("id").cast("int").alias("c"))
    all_ = classes.join(per, "c", "left").na.fill(0)
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)).cast("double"), 9)
    return all_.select(F.col("c").alias("rating"), "n_true", "n_predicted", share("tp", "n_true").alias("recall"), share("tp", "n_predicted").alias("precision"), share("err", "n_true").alias("mae"))


def noise_distance(detected: DataFrame, threshold: int = SEVERITY) -> DataFrame:
    """How far flagged rows of each label lie from their prediction; always five rows."""
    noise, d = F.col("is_noise"), F.least("rating_diff", F.lit(4))
    per = detected.groupBy("rating").agg(
        F.count("*").alias("n_class"),
        F.count_if(noise).alias("n_flagged"),
        *(F.count_if(noise & (d == k)).alias(f"n_distance{k}") for k in range(1, 5)),
        F.count_if(noise & (F.col("rating_diff") >= threshold)).alias("n_severe"),
    )
    classes = detected.sparkSession.range(1, NUM_CLASSES + 1).select(F.col("id").cast("int").alias("rating"))
    all_ = classes.join(per, "rating", "left").na.fill(0)
    pct = lambda a, b: F.round(100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return all_.withColumns({"pct_flagged": pct("n_flagged", "n_class"), "pct_severe": pct("n_severe", "n_flagged")})


def confound_markers(distance: DataFrame, quality: DataFrame) -> DataFrame:
    """Labels among the two with most severe flags and the two with least recall (or precision)."""
    joined = distance.select("rating", "pct_severe").join(quality.select("rating", "recall", "precision"), "rating", "left")
    valid = F.col("pct_severe").isNotNull() & F.col("recall").isNotNull()

    def among(order: Column, ok: Column) -> Column:
        rank = F.row_number().over(Window.orderBy(F.when(ok, 0).otherwise(1), order, "rating"))  # five rows
        return ok & (rank <= 2)

    marked = joined.withColumns(
        {"_top": among(F.desc("pct_severe"), valid), "_recall": among(F.asc("recall"), valid), "_precision": among(F.asc("precision"), valid & F.col("precision").isNotNull())}
    )
    return marked.select("rating", "pct_severe", "recall", "precision", (F.col("_top") & F.col("_recall")).alias("confound_recall"), (F.col("_top") & F.col("_precision")).alias("confound_precision"))


def ablation_table(rows: list[DataFrame]) -> DataFrame:
    """One row a proxy, in the order of their ids; columns that a proxy lacks are null."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy("proxy_id")


def jaccard(a: DataFrame, b: DataFrame, key: str = "review_id") -> DataFrame:
    """Similarity of two id sets; null if both are empty."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))
    return per.agg(both.alias("n_both"), F.count("*").alias("n_any"), F.round(both / F.nullif(F.count("*"), F.lit(0)).cast("double"), 9).alias("jaccard"))
