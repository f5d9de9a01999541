"""Review-shaped inputs derived from the driver's tables, in Spark and as SQL for the oracle.

There is no review corpus: documents stand for reviews, and orders, whose priority has five levels,
for labelled rows with class probabilities and predictions. All randomness is hashed, so both engines
derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions.rng import h, sql_h
from ratelens.operators.resampling import BUCKETS, bucket_of
from ratelens.plans.config import SCENARIOS, WEIGHT_SEEDS
from ratelens.sources.tables import table


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("source_app"),
        F.col("text").alias("review_text"),
        F.col("lang").alias("detected_lang"),
        (1 + h("rating", F.col("doc_id")) % 5).cast("int").alias("rating"),
        F.date_add(F.lit("2026-01-01").cast("date"), (h("date", F.col("doc_id")) % 200).cast("int")).alias("date"),
    )


REVIEWS_SQL = f"""reviews AS (SELECT doc_id AS review_id, source AS source_app, text AS review_text, lang AS detected_lang,
  (1 + {sql_h("'rating'", "doc_id")} % 5)::INT AS rating, (DATE '2026-01-01' + ({sql_h("'date'", "doc_id")} % 200)::INT)::DATE AS date FROM documents)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_id, rating, source_app, probs``: a latent class gets a bonus, so labels can be wrong."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"), F.col("o_orderstatus").alias("source_app"))
    k, r = F.col("review_id"), F.col("rating")
    z = F.when(h("z", k) % 4 == 0, (r + h("s", k) % 4) % 5 + 1).otherwise(r)
    o = o.withColumn("z", z)
    w = [(h(f"w{j}", k) % 1000 + 1 + F.when(F.col("z") == j, 6000).otherwise(0)).cast("double").alias(f"w{j}") for j in range(1, 6)]
    o = o.select("review_id", "rating", "source_app", *w)
    total = F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4") + F.col("w5")
    return o.select("review_id", "rating", "source_app", F.array(*(F.col(f"w{j}") / total for j in range(1, 6))).alias("probs"))


SCORED_SQL = f"""z0 AS (SELECT o_orderkey AS review_id, substr(o_orderpriority, 1, 1)::INT AS rating, o_orderstatus AS source_app FROM orders),
z1 AS (SELECT *, CASE WHEN {sql_h("'z'", "review_id")} % 4 = 0 THEN (rating + {sql_h("'s'", "review_id")} % 4) % 5 + 1 ELSE rating END AS z FROM z0),
z2 AS (SELECT review_id, rating, source_app, {", ".join(f"({sql_h(repr(f'w{j}'), 'review_id')} % 1000 + 1 + CASE WHEN z = {j} THEN 6000 ELSE 0 END)::DOUBLE AS w{j}" for j in range(1, 6))} FROM z1),
scored AS (SELECT review_id, rating, source_app, {", ".join(f"w{j} / (w1 + w2 + w3 + w4 + w5) AS p{j}" for j in range(1, 6))} FROM z2),
best AS (SELECT *, CASE greatest(p1, p2, p3, p4, p5) WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3 WHEN p4 THEN 4 ELSE 5 END AS predicted FROM scored)"""


def predictions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Long table ``scenario, weight_seed, review_id, y_true, y_pred`` of 6 scenarios by 3 seeds.

    ``dealt``: with ``draw_bucket``, by which the reviews are dealt while they are a narrow row each, before their predictions are made.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("y_true"))
    own = ["draw_bucket"] if dealt else []
    if dealt:
        o = o.withColumn("draw_bucket", bucket_of(F.col("review_id"))).repartition(BUCKETS, "draw_bucket")
    units = F.array(*(F.struct(F.lit(s["name"]).alias("scenario"), F.lit(w).alias("weight_seed")) for s in SCENARIOS for w in WEIGHT_SEEDS))
    o = o.select(*own, "review_id", "y_true", F.explode(units).alias("u")).select(*own, "review_id", "y_true", "u.scenario", "u.weight_seed")
    shift = h(F.col("scenario"), F.col("weight_seed"), F.col("review_id")) % 5 - 2
    y = F.least(F.greatest(F.col("y_true") + shift, F.lit(1)), F.lit(5)).cast("int")
    return o.select("scenario", "weight_seed", "review_id", "y_true", y.alias("y_pred"), *own)


_UNITS = ", ".join(f"('{s['name']}', {w})" for s in SCENARIOS for w in WEIGHT_SEEDS)
PREDICTIONS_SQL = f"""units(scenario, weight_seed) AS (VALUES {_UNITS}),
predictions AS (SELECT scenario, weight_seed, o_orderkey AS review_id, substr(o_orderpriority, 1, 1)::INT AS y_true,
  least(greatest(substr(o_orderpriority, 1, 1)::INT + {sql_h("scenario", "weight_seed", "o_orderkey")} % 5 - 2, 1), 5)::INT AS y_pred FROM orders, units)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_id, rating_diff, verdict, verdict_2, gold, gold_2``; the second ones for about 30 per cent."""
    s = scored(spark, sf_dir)
    k = F.col("review_id")
    verdict = lambda tag: F.element_at(F.array(F.lit("noise"), F.lit("not_noise"), F.lit("ambiguous")), (h(tag, k) % 3 + 1).cast("int"))
    rating = lambda tag: F.when(h(tag, k) % 10 == 0, "ND").otherwise((h(tag, k) % 5 + 1).cast("string"))
    second = h("second", k) % 10 < 3
    return s.select(
        "review_id",
        (h("diff", k) % 4 + 1).cast("int").alias("rating_diff"),
        verdict("v").alias("verdict"),
        F.when(second, F.when(h("same", k) % 2 == 0, verdict("v")).otherwise(verdict("v2"))).alias("verdict_2"),
        rating("g").alias("gold"),
        F.when(second, F.when(h("same", k) % 2 == 0, rating("g")).otherwise(rating("g2"))).alias("gold_2"),
    )


def _v(tag: str) -> str:
    return f"list_extract(['noise', 'not_noise', 'ambiguous'], ({sql_h(repr(tag), 'review_id')} % 3 + 1)::INT)"


def _g(tag: str) -> str:
    return f"CASE WHEN {sql_h(repr(tag), 'review_id')} % 10 = 0 THEN 'ND' ELSE ({sql_h(repr(tag), 'review_id')} % 5 + 1)::VARCHAR END"


_SECOND, _SAME = f"{sql_h(repr('second'), 'review_id')} % 10 < 3", f"{sql_h(repr('same'), 'review_id')} % 2 = 0"
ANNOTATIONS_SQL = f"""annotations AS (SELECT review_id, ({sql_h("'diff'", "review_id")} % 4 + 1)::INT AS rating_diff, {_v("v")} AS verdict,
  CASE WHEN {_SECOND} THEN CASE WHEN {_SAME} THEN {_v("v")} ELSE {_v("v2")} END END AS verdict_2, {_g("g")} AS gold,
  CASE WHEN {_SECOND} THEN CASE WHEN {_SAME} THEN {_g("g")} ELSE {_g("g2")} END END AS gold_2 FROM (SELECT o_orderkey AS review_id FROM orders))"""

#: Replacements for frequent words of the documents, and the two of the tests.
SLANG = {"the": "teh", "and": "n", "und": "u", "die": "d", "les": "l", "que": "q", "of": "o", "in": "inn", "gpp": "tidak apa-apa", "bgt": "banget"}

#: Effects of one hypothesis and metric in up to three splits: the verdict cases of the tests.
EFFECTS = [
    ("H1", "MAE", 42, -0.06, -0.08, -0.04), ("H1", "MAE", 123, -0.05, -0.07, -0.03), ("H1", "MAE", 2024, -0.04, -0.09, 0.01),
    ("H4", "MAE", 42, -0.001, -0.014, 0.013), ("H4", "MAE", 123, -0.002, -0.01, 0.01), ("H4", "MAE", 2024, -0.03, -0.05, -0.01),
    ("H2", "MAE", 42, 0.02, 0.01, 0.03), ("H2", "MAE", 123, 0.02, 0.01, 0.03), ("H2", "MAE", 2024, -0.02, -0.03, -0.01),
    ("H2", "QWK_ensemble", 42, -0.01, -0.02, -0.001), ("H2", "QWK_ensemble", 123, -0.012, -0.02, -0.003), ("H2", "QWK_ensemble", 2024, -0.009, -0.02, 0.002),
    ("H1", "QWK_per_seed", 42, -0.1, -0.2, -0.1), ("H1", "QWK_per_seed", 123, -0.1, -0.2, -0.1),
]


def effects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EFFECTS, "hypothesis string, metric string, split_seed int, diff double, ci_low double, ci_high double")
