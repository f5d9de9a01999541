"""Human annotation: agreement rates, kappas, gold labels and what scenarios score on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.ordinal import metrics, qwk
from ratelens.plans.config import UNDETERMINED

VERDICTS = ("noise", "not_noise", "ambiguous")


def is_blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none")


def agreement_summary(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Counts of the verdicts and the share that calls a flag right."""
    v = F.col(verdict)
    n = F.count_if(v.isin(*VERDICTS))
    return df.agg(n.alias("n"), *(F.count_if(v == x).alias(f"n_{x}") for x in VERDICTS), F.round(F.count_if(v == "noise") / F.nullif(n, F.lit(0)).cast("double"), 6).alias("agreement"))


def agreement_by_distance(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    v = F.col(verdict)
    pct = [F.round(100.0 * F.count_if(v == x) / F.count("*"), 6).alias(f"pct_{x}") for x in VERDICTS]
    return df.where(v.isin(*VERDICTS)).groupBy("rating_diff").agg(F.count("*").alias("n"), *pct).orderBy("rating_diff")


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unweighted kappa of complete pairs, from one small table of label pairs."""
    pairs = df.where(~is_blank(F.col(a)) & ~is_blank(F.col(b))).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    labels = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("n").alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("b").alias("v"), F.lit(0.0).alias("x"), F.col("n").alias("y")))).alias("m")).select("m.*")
    margins = labels.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0.0)).alias("same"))
    po, pe = F.col("same") / F.nullif(F.col("n"), F.lit(0.0)), F.col("chance") / F.nullif(F.col("n") * F.col("n"), F.lit(0.0))
    return total.crossJoin(margins).select(F.col("n").cast("long").alias("n"), F.round(po, 9).alias("observed"), F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 9).alias("kappa"))


def gold_rating(c: Column) -> Column:
    """The rating of a gold label; null for blank and undetermined ones."""
    return F.when(~is_blank(c) & (F.upper(F.trim(c)) != UNDETERMINED), F.expr("1") * c.try_cast("double")).try_cast("int")


def gold_labels(df: DataFrame, column: str = "gold") -> DataFrame:
    """``review_id, gold_rating`` with undetermined ones left out; anything else than 1 to 5 is an error."""
    c = F.col(column)
    known = ~is_blank(c) & (F.upper(F.trim(c)) != UNDETERMINED)
    rating = gold_rating(c)
    valid = F.coalesce(rating.between(1, 5) & (c.try_cast("double") == rating), F.lit(False))
    checked = F.when(valid, rating).otherwise(F.raise_error(F.concat(F.lit("gold label is not 1 to 5: "), c)).cast("int"))
    return df.where(known).select("review_id", checked.alias("gold_rating"))


def undetermined_share(df: DataFrame, column: str = "gold") -> DataFrame:
    c = F.col(column)
    filled, nd = F.count_if(~is_blank(c)), F.count_if(F.upper(F.trim(c)) == UNDETERMINED)
    return df.agg(filled.alias("n_filled"), nd.alias("n_undetermined"), F.round(nd / F.nullif(filled, F.lit(0)).cast("double"), 9).alias("share_undetermined"))


def gold_kappa(df: DataFrame, a: str = "gold", b: str = "gold_2") -> DataFrame:
    """Quadratic kappa of two annotators where both determined a rating."""
    pairs = df.select(gold_rating(F.col(a)).alias("a"), gold_rating(F.col(b)).alias("b")).where("a is not null and b is not null")
    return pairs.agg(F.count("*").alias("n"), F.round(qwk(F.col("a"), F.col("b")), 9).alias("kappa"))


def gold_evaluation(long: DataFrame, gold: DataFrame) -> DataFrame:
    """Stored predictions against gold labels: metrics of each seed, averaged by scenario."""
    joined = long.join(gold, "review_id")
    per = joined.groupBy("scenario", "weight_seed").agg(F.count("*").alias("n"), *metrics(F.col("gold_rating"), F.col("y_pred")))
    names = ("mae", "rmse", "accuracy", "off_by_one", "qwk")
    return per.groupBy("scenario").agg(F.max("n").alias("n_gold"), *(F.round(F.avg(m), 9).alias(m.upper()) for m in names)).orderBy("MAE")


def gold_effects(mae: DataFrame) -> DataFrame:
    """Direction words for MAE effects on gold labels."""
    way = F.when(F.col("diff") < 0, "A better").when(F.col("diff") > 0, "B better").otherwise("tie")
    return mae.withColumns({"direction": way, "crosses_zero": (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)})


def unmatched(ids: DataFrame, known: DataFrame, key: str = "review_id") -> DataFrame:
    """Ids (as text) that ``known`` lacks; empty for a subset."""
    left = ids.select(F.col(key).cast("string").alias(key)).distinct()
    return left.join(known.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_anti")


def nearest_first(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("review_id"))).where(F.col("rank") <= n)


def _or_raise(found: Column, value: Column, what: str, key: str) -> Column:
    """``value`` where the other side was found; else the job ends with the id that has none."""
    return F.when(found.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(what), F.col(key).cast("string"))))


def paired(first: DataFrame, second: DataFrame, suffixes: tuple[str, str] = ("_1", "_2"), key: str = "review_id") -> DataFrame:
    """The second annotator's (or later) rows beside the first one's; columns that both have get the suffixes.

    Ids are compared as text. An id of ``second`` that ``first`` lacks ends the job: a subset must come from its parent.
    """
    both = (set(first.columns) & set(second.columns)) - {key}
    named = lambda df, s: df.select(F.col(key).cast("string").alias(key), *(F.col(c).alias(c + s if c in both else c) for c in df.columns if c != key))
    joined = named(second, suffixes[1]).join(named(first, suffixes[0]).withColumn("_found", F.lit(True)), key, "left")
    return joined.withColumn(key, _or_raise(F.col("_found"), F.col(key), "the first annotator lacks review ", key)).drop("_found")


def with_distance(sample: DataFrame, flagged: DataFrame, key: str = "review_id", distance: str = "rating_diff") -> DataFrame:
    """``sample`` with the distance of its flagged rows; a row that isn't flagged ends the job."""
    known = flagged.select(F.col(key).cast("string").alias(key), F.col(distance).alias("_distance"))
    joined = sample.drop(distance).withColumn(key, F.col(key).cast("string")).join(known, key, "left")
    return joined.withColumn(distance, _or_raise(F.col("_distance"), F.col("_distance"), "no flagged row for review ", key)).drop("_distance")
