"""Queries over labelled rows with class probabilities: calibration, confident learning, diagnostics, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.functions import calibration as cal
from ratelens.functions import ordinal
from ratelens.functions.rng import h, sql_h
from ratelens.operators import checks, confident, models, preprocess, proxies, splitting
from ratelens.operators.oof_store import OofStore
from ratelens.plans.config import CV_FOLDS, N_BOOT
from ratelens.plans.fixtures import SCORED_SQL, reviews, scored
from ratelens.plans.registry import Registry
from ratelens.sources.store import store_path
from ratelens.sources.tables import table

R = Registry(SCORED_SQL)
add = R.add
P = ("p1", "p2", "p3", "p4", "p5")


def predicted(spark, sf):
    return confident.with_predictions(scored(spark, sf))


# Ordinal metrics of the proxy
add("qwk_five_sum", lambda s, d: predicted(s, d).agg(F.round(ordinal.qwk(F.col("rating"), F.col("predicted_rating")), 9).alias("qwk")), f"SELECT round({ordinal.sql_qwk('rating', 'predicted')}, 9) AS qwk FROM best")


def qwk_confusion(spark, sf):
    """The same from the confusion matrix; both must be equal."""
    cells = predicted(spark, sf).groupBy(F.col("rating").alias("y"), F.col("predicted_rating").alias("p")).agg(F.count("*").cast("double").alias("n"))
    w = (F.col("y") - F.col("p")) * (F.col("y") - F.col("p")) / 16.0
    both = cells.select(F.explode(F.array(F.struct(F.lit("y").alias("side"), F.col("y").alias("v"), "n"), F.struct(F.lit("p").alias("side"), F.col("p").alias("v"), "n"))).alias("x")).select("x.*")
    margin = both.groupBy("side", "v").agg(F.sum("n").alias("n"))
    a, b = margin.where("side = 'y'").select(F.col("v").alias("i"), F.col("n").alias("a")), margin.where("side = 'p'").select(F.col("v").alias("j"), F.col("n").alias("b"))
    expected = a.crossJoin(b).agg(F.sum(F.col("a") * F.col("b") * (F.col("i") - F.col("j")) * (F.col("i") - F.col("j")) / 16.0).alias("e"))  # five by five
    observed = cells.agg(F.sum(w * F.col("n")).alias("o"), F.sum("n").alias("n"))
    return observed.crossJoin(expected).select(F.round(1.0 - F.col("o") / (F.col("e") / F.col("n")), 9).alias("qwk"))


add(
    "qwk_confusion",
    qwk_confusion,
    """o AS (SELECT rating AS y, predicted AS p, count(*)::DOUBLE AS n FROM best GROUP BY 1, 2), a AS (SELECT y AS i, sum(n) AS a FROM o GROUP BY 1), b AS (SELECT p AS j, sum(n) AS b FROM o GROUP BY 1)
--> SELECT round(1 - (SELECT sum((y - p) * (y - p) * n) FROM o) / ((SELECT sum(a * b * (i - j) * (i - j)) FROM a, b) / (SELECT sum(n) FROM o)), 9) AS qwk""",
)


# Calibration
def thresholds(spark, sf):
    q = cal.derived_cumulative(F.col("probs"))
    long = scored(spark, sf).select("rating", F.posexplode(q).alias("k", "q"))
    return long.select((F.col("k") + 1).alias("k"), "q", (F.col("rating") - 1 > F.col("k")).cast("int").alias("event"))


TAIL = {k: " + ".join(["0.0", *P[k:]]) for k in range(1, 5)}
LONG = "long AS (" + " UNION ALL ".join(f"SELECT {k}::INT AS k, {TAIL[k]} AS q, (rating - 1 > {k - 1})::INT AS event FROM scored" for k in range(1, 5)) + ")"
BIN = "least(greatest(floor({0} * 10), 0), 9)::INT"
ECE = f"b AS (SELECT k, {BIN.format('q')} AS bin, count(*) AS n, avg(q) AS mq, avg(event::DOUBLE) AS me FROM long GROUP BY 1, 2), e AS (SELECT k, sum(n * abs(me - mq)) / sum(n) AS ece FROM b GROUP BY k)"
add(
    "ece_binary",
    lambda s, d: cal.ece(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select((h("conf", F.col("doc_id")) / float(2**32)).alias("p"), "quality"), "p", "quality").select(F.round("ece", 9).alias("ece")),
    f"j AS (SELECT {sql_h(repr('conf'), 'doc_id')} / 4294967296.0::DOUBLE AS p, quality FROM documents JOIN labels USING (doc_id)), b AS (SELECT {BIN.format('p')} AS bin, count(*) AS n, avg(p) AS mp, avg(quality::DOUBLE) AS me FROM j GROUP BY 1) --> SELECT round(sum(n * abs(me - mp)) / sum(n), 9) AS ece FROM b",
)
add("ece_cumulative", lambda s, d: cal.ece(thresholds(s, d), "q", "event", ("k",)).select("k", F.round("ece", 9).alias("ece")), f"{LONG}, {ECE} --> SELECT k, round(ece, 9) AS ece FROM e")
add(
    "ece_top_label",
    lambda s, d: cal.ece(predicted(s, d).select(F.array_max("probs").alias("p"), (F.col("rating") == F.col("predicted_rating")).alias("ok")), "p", "ok").select(F.round("ece", 9).alias("ece")),
    f"t AS (SELECT greatest({', '.join(P)}) AS q, (rating = predicted)::INT AS event FROM best), b AS (SELECT {BIN.format('q')} AS bin, count(*) AS n, avg(q) AS mq, avg(event::DOUBLE) AS me FROM t GROUP BY 1) --> SELECT round(sum(n * abs(me - mq)) / sum(n), 9) AS ece FROM b",
)


def chained(spark, sf):
    """A hashed ordinal chain beside the probabilities, with some rises."""
    q = F.array(*(h(f"q{k}", F.col("review_id")) / float(2**32) * (1.1 - 0.2 * k) for k in range(1, 5)))
    return scored(spark, sf).withColumn("q_chain", q)


CHAIN = "chain AS (SELECT *, " + ", ".join(f"{sql_h(repr(f'q{k}'), 'review_id')} / 4294967296.0::DOUBLE * {1.1 - 0.2 * k}::DOUBLE AS q{k}" for k in range(1, 5)) + " FROM scored)"
add(
    "monotonicity",
    lambda s, d: cal.monotonicity(chained(s, d), "q_chain").select("n_rows", "n_violating", F.round("share_monotone", 9).alias("share_monotone"), F.round("largest_rise", 9).alias("largest_rise")),
    f"{CHAIN}, m AS (SELECT greatest(q2 - q1, q3 - q2, q4 - q3) AS r FROM chain) --> SELECT count(*) AS n_rows, count(*) FILTER (r > 0) AS n_violating, round(1.0::DOUBLE - count(*) FILTER (r > 0) / greatest(count(*), 1)::DOUBLE, 9) AS share_monotone, round(max(r), 9) AS largest_rise FROM m",
)
GAPS = "gaps AS (" + " UNION ALL ".join(f"SELECT abs(q{k} - ({TAIL[k]})) AS gap FROM chain" for k in range(1, 5)) + ")"
add("chain_gap", lambda s, d: cal.chain_gap(chained(s, d), "q_chain", "probs").select(F.round("gap_max", 9).alias("gap_max"), F.round("gap_mean", 9).alias("gap_mean")), f"{CHAIN}, {GAPS} --> SELECT round(max(gap), 9) AS gap_max, round(avg(gap), 9) AS gap_mean FROM gaps")
add(
    "per_class_quality",
    lambda s, d: confident.per_class_quality(predicted(s, d)),
    """c AS (SELECT unnest(range(1, 6))::INT AS r) --> SELECT r AS rating, count(*) FILTER (best.rating = r) AS n_true, count(*) FILTER (predicted = r) AS n_predicted,
  round(count(*) FILTER (best.rating = r AND predicted = r) / nullif(count(*) FILTER (best.rating = r), 0)::DOUBLE, 9) AS recall,
  round(count(*) FILTER (best.rating = r AND predicted = r) / nullif(count(*) FILTER (predicted = r), 0)::DOUBLE, 9) AS precision,
  round((avg(abs(best.rating - predicted)) FILTER (best.rating = r))::DOUBLE, 9) AS mae FROM c, best GROUP BY r""",
)


def logits(spark, sf):
    z = F.array(*((h(f"z{k}", F.col("review_id")) / float(2**32)) * 6.0 - 1.0 - 1.0 * k for k in range(1, 5)))
    return scored(spark, sf).select("review_id", "rating", z.alias("z"))


LOGITS = "lg AS (SELECT review_id, rating, " + ", ".join(f"({sql_h(repr(f'z{k}'), 'review_id')} / 4294967296.0::DOUBLE) * 6.0::DOUBLE - 1.0::DOUBLE - 1.0::DOUBLE * {k} AS z{k}" for k in range(1, 5)) + " FROM scored)"
SIG = [f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-z{k})))" for k in range(1, 5)]
CORN = f"{LOGITS}, qq AS (SELECT review_id, " + ", ".join(f"{' * '.join(SIG[: k + 1])} AS q{k + 1}" for k in range(4)) + " FROM lg), raw AS (SELECT review_id, greatest(1 - q1, 1e-8::DOUBLE) AS a1, greatest(q1 - q2, 1e-8::DOUBLE) AS a2, greatest(q2 - q3, 1e-8::DOUBLE) AS a3, greatest(q3 - q4, 1e-8::DOUBLE) AS a4, greatest(q4, 1e-8::DOUBLE) AS a5, (q1 > 0.5)::INT + (q2 > 0.5)::INT + (q3 > 0.5)::INT + (q4 > 0.5)::INT AS decoded FROM qq)"


def corn_chain(spark, sf):
    q = logits(spark, sf).withColumn("q", cal.chain(F.col("z")))
    p = q.withColumn("p", cal.chain_probs(F.col("q")))
    return p.select("review_id", *(F.round(F.col("p")[k], 9).alias(f"p{k + 1}") for k in range(5)), cal.rank_decode(F.col("q")).alias("decoded"))


add("corn_chain", corn_chain, f"{CORN} --> SELECT review_id, " + ", ".join(f"round(a{k} / (a1 + a2 + a3 + a4 + a5), 9) AS p{k}" for k in range(1, 6)) + ", decoded FROM raw")


def temperature_grid(spark, sf):
    z = F.array(*(F.log(F.col("probs")[k]) * 2.0 for k in range(5)))
    rows = scored(spark, sf).select(z.alias("logits"), (F.col("rating") - 1).alias("label0"))
    return models.temperature_grid(rows, (0.5, 1.0, 1.5, 2.0, 3.0)).select("temperature", F.round("nll", 9).alias("nll"))


_E = " + ".join(f"exp(2.0::DOUBLE * ln(p{k}) / t)" for k in range(1, 6))
add(
    "temperature_grid",
    temperature_grid,
    f"g(t) AS (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0), (3.0)) --> SELECT t AS temperature, round(avg(-ln(greatest(exp(2.0::DOUBLE * ln(CASE rating WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4 ELSE p5 END) / t) / ({_E}), 1e-8::DOUBLE))), 9) AS nll FROM scored, g GROUP BY t",
)


def calibration_report(spark, sf):
    """One wide row: error of the likeliest class, of each threshold and their mean, monotonicity of the chain, its gap to the probabilities."""
    per = cal.ece(thresholds(spark, sf), "q", "event", ("k",))
    cum = per.agg(*(F.round(F.max(F.when(F.col("k") == k, F.col("ece"))), 9).alias(f"ece_threshold{k}") for k in range(1, 5)), F.round(F.avg("ece"), 9).alias("ece_mean"))
    top = cal.ece(predicted(spark, sf).select(F.array_max("probs").alias("p"), (F.col("rating") == F.col("predicted_rating")).alias("ok")), "p", "ok").select(F.round("ece", 9).alias("ece_top_label"))
    own = chained(spark, sf)
    mono = cal.monotonicity(own, "q_chain").select("n_rows", "n_violating", F.round("share_monotone", 9).alias("share_monotone"), F.round("largest_rise", 9).alias("largest_rise"))
    gap = cal.chain_gap(own, "q_chain", "probs").select(F.round("gap_max", 9).alias("chain_gap__max"), F.round("gap_mean", 9).alias("chain_gap__mean"))
    return cum.crossJoin(top).crossJoin(mono.select(*(F.col(c).alias(f"monotonicity__{c}") for c in mono.columns))).crossJoin(gap)  # one row each


add(
    "calibration_report",
    calibration_report,
    f"""{LONG}, {ECE}, {CHAIN}, {GAPS}, mo AS (SELECT greatest(q2 - q1, q3 - q2, q4 - q3) AS r FROM chain), t AS (SELECT greatest({', '.join(P)}) AS q, (rating = predicted)::INT AS event FROM best), tb AS (SELECT {BIN.format('q')} AS bin, count(*) AS n, avg(q) AS mq, avg(event::DOUBLE) AS me FROM t GROUP BY 1)
--> SELECT {", ".join(f"round(max(ece) FILTER (k = {k}), 9) AS ece_threshold{k}" for k in range(1, 5))}, round(avg(ece), 9) AS ece_mean, (SELECT round(sum(n * abs(me - mq)) / sum(n), 9) FROM tb) AS ece_top_label,
(SELECT count(*) FROM mo) AS monotonicity__n_rows, (SELECT count(*) FILTER (r > 0) FROM mo) AS monotonicity__n_violating, (SELECT round(1.0::DOUBLE - count(*) FILTER (r > 0) / greatest(count(*), 1)::DOUBLE, 9) FROM mo) AS monotonicity__share_monotone, (SELECT round(max(r), 9) FROM mo) AS monotonicity__largest_rise,
(SELECT round(max(gap), 9) FROM gaps) AS chain_gap__max, (SELECT round(avg(gap), 9) FROM gaps) AS chain_gap__mean FROM e""",
)

# Confident learning
T = ", ".join(f"avg(p{j}) FILTER (rating = {j}) AS t{j}" for j in range(1, 6))
PASS = ", ".join(f"CASE WHEN p{j} >= t{j} THEN p{j} ELSE -1 END" for j in range(1, 6))
CL = f"""th AS (SELECT {T} FROM scored),
cc AS (SELECT best.*, greatest({PASS}) AS g, {", ".join(f"CASE WHEN p{j} >= t{j} THEN p{j} ELSE -1 END AS c{j}" for j in range(1, 6))} FROM best, th),
cf AS (SELECT *, CASE WHEN g < 0 THEN NULL WHEN g = c1 THEN 1 WHEN g = c2 THEN 2 WHEN g = c3 THEN 3 WHEN g = c4 THEN 4 ELSE 5 END AS confident FROM cc),
cells AS (SELECT i::INT AS rating, j::INT AS confident FROM range(1, 6) a(i), range(1, 6) b(j)),
jo AS (SELECT cells.rating, cells.confident, count(cf.review_id) AS n FROM cells LEFT JOIN cf ON cells.rating = cf.rating AND cells.confident = cf.confident GROUP BY 1, 2),
ln AS (SELECT rating, count(*) AS label_n FROM scored GROUP BY 1),
sc AS (SELECT jo.*, label_n, coalesce(n * label_n / nullif(sum(n) OVER (PARTITION BY jo.rating), 0)::DOUBLE, 0) AS scaled FROM jo LEFT JOIN ln USING (rating)),
cj AS (SELECT rating, confident, n, label_n, scaled * (SELECT count(*) FROM scored) / nullif(sum(scaled) OVER (), 0) AS calibrated FROM sc),
est AS (SELECT floor(sum(calibrated) FILTER (rating <> confident))::BIGINT AS estimated FROM cj),
qu AS (SELECT rating, confident AS other, round_even(calibrated, 0)::BIGINT AS quota FROM cj WHERE rating <> confident AND label_n >= 20 AND round_even(calibrated, 0) > 0),
mg AS (SELECT review_id, cf.rating, other, quota, row_number() OVER (PARTITION BY cf.rating, other ORDER BY [p1, p2, p3, p4, p5][other] - [p1, p2, p3, p4, p5][cf.rating] DESC, review_id) AS rk FROM cf JOIN qu ON cf.rating = qu.rating WHERE predicted <> cf.rating),
pk AS (SELECT DISTINCT review_id FROM mg WHERE rk <= quota),
fl AS (SELECT cf.review_id, rating, source_app, predicted AS predicted_rating, abs(rating - predicted)::INT AS rating_diff, confident IS NOT NULL AND confident <> rating AND predicted <> rating AS confident_learning, pk.review_id IS NOT NULL AS prune_by_noise_rate FROM cf LEFT JOIN pk ON cf.review_id = pk.review_id),
mc AS (SELECT 'confident_learning' AS method, 0 AS ord, count(*) FILTER (confident_learning) AS n_flagged FROM fl UNION ALL SELECT 'prune_by_noise_rate', 1, count(*) FILTER (prune_by_noise_rate) FROM fl),
sel AS (SELECT arg_min(method, abs(n_flagged - estimated) * 10 + ord) AS selected, arg_min(n_flagged, abs(n_flagged - estimated) * 10 + ord) AS n_flagged, max(estimated) AS estimated FROM mc, est),
de0 AS (SELECT fl.*, CASE WHEN selected = 'confident_learning' THEN confident_learning ELSE prune_by_noise_rate END AS is_noise FROM fl, sel),
de AS (SELECT *, is_noise AND rating_diff >= 2 AS is_noise_severe FROM de0)"""
add("cl_thresholds", lambda s, d: confident.thresholds(scored(s, d)).select("rating", F.round("threshold", 9).alias("threshold"), "n"), "SELECT rating, round(avg([p1, p2, p3, p4, p5][rating]), 9) AS threshold, count(*) AS n FROM scored GROUP BY rating")
add("confident_joint", lambda s, d: confident.confident_joint(scored(s, d)), f"{CL} --> SELECT * FROM jo")
add("calibrated_joint", lambda s, d: confident.calibrated_joint(scored(s, d)).select("rating", "confident", F.round("calibrated", 6).alias("calibrated")), f"{CL} --> SELECT rating, confident, round(calibrated, 6) AS calibrated FROM cj")
FLAGS = ("review_id", "rating", "predicted_rating", "rating_diff", "confident_learning")
add("cl_flags", lambda s, d: confident.flags(scored(s, d)).select(*FLAGS), f"{CL} --> SELECT {', '.join(FLAGS)} FROM fl")
add("prune_by_noise_rate", lambda s, d: confident.flags(scored(s, d)).where("prune_by_noise_rate").select("review_id", "rating", "predicted_rating"), f"{CL} --> SELECT review_id, rating, predicted_rating FROM fl WHERE prune_by_noise_rate")


def select_method(spark, sf):
    return confident.select_method(scored(spark, sf))


add("cl_select_method", select_method, f"{CL} --> SELECT * FROM sel")
add("detect_noise", lambda s, d: confident.detect(scored(s, d)).select("review_id", "rating", "predicted_rating", "is_noise", "is_noise_severe"), f"{CL} --> SELECT review_id, rating, predicted_rating, is_noise, is_noise_severe FROM de")


def variants(spark, sf):
    """Variants after conflict resolution; the hashed text stands for the cleaned one."""
    rows = confident.detect(scored(spark, sf)).withColumn("cleaned_text", (F.col("review_id") / 3).cast("long").cast("string"))
    return confident.variant_counts(preprocess.resolve_conflicts(rows))


add(
    "noise_variants",
    variants,
    f"""{CL}, tx AS (SELECT *, (review_id // 3)::VARCHAR AS t FROM de), pr AS (SELECT t, rating, count(*) AS n FROM tx GROUP BY 1, 2), tp AS (SELECT t, rating FROM pr QUALIFY n = max(n) OVER (PARTITION BY t)),
un AS (SELECT t, min(rating) AS rating FROM tp GROUP BY t HAVING count(*) = 1), rs AS (SELECT tx.* FROM tx JOIN un ON tx.t = un.t AND tx.rating = un.rating)
--> SELECT 'raw' AS variant, count(*) AS n FROM rs UNION ALL SELECT 'hard', count(*) FROM rs WHERE NOT is_noise UNION ALL SELECT 'severe', count(*) FROM rs WHERE NOT is_noise_severe""",
)
DIST = f"""{CL}, nd AS (SELECT rating, count(*) AS n_class, count(*) FILTER (is_noise) AS n_flagged, {", ".join(f"count(*) FILTER (is_noise AND least(rating_diff, 4) = {k}) AS n_distance{k}" for k in range(1, 5))}, count(*) FILTER (is_noise AND rating_diff >= 2) AS n_severe FROM de GROUP BY rating),
nd2 AS (SELECT *, round(100.0::DOUBLE * n_flagged / nullif(n_class, 0), 6) AS pct_flagged, round(100.0::DOUBLE * n_severe / nullif(n_flagged, 0), 6) AS pct_severe FROM nd)"""
add("noise_distance_by_class", lambda s, d: confident.noise_distance(confident.detect(scored(s, d))), f"{DIST} --> SELECT * FROM nd2")


def confounds(spark, sf):
    rows = confident.detect(scored(spark, sf))
    return confident.confound_markers(confident.noise_distance(rows), confident.per_class_quality(rows))


add(
    "confound_marker",
    confounds,
    f"""{DIST}, ql AS (SELECT r AS rating, round(count(*) FILTER (best.rating = r AND predicted = r) / nullif(count(*) FILTER (best.rating = r), 0)::DOUBLE, 9) AS recall,
  round(count(*) FILTER (best.rating = r AND predicted = r) / nullif(count(*) FILTER (predicted = r), 0)::DOUBLE, 9) AS precision FROM range(1, 6) t(r), best GROUP BY r),
jn AS (SELECT nd2.rating, pct_severe, recall, precision, pct_severe IS NOT NULL AND recall IS NOT NULL AS ok FROM nd2 LEFT JOIN ql ON nd2.rating = ql.rating),
rk AS (SELECT *, row_number() OVER (ORDER BY ok DESC, pct_severe DESC, rating) <= 2 AND ok AS a, row_number() OVER (ORDER BY ok DESC, recall, rating) <= 2 AND ok AS b, row_number() OVER (ORDER BY (ok AND precision IS NOT NULL) DESC, precision, rating) <= 2 AND ok AND precision IS NOT NULL AS c FROM jn)
--> SELECT rating, pct_severe, recall, precision, a AND b AS confound_recall, a AND c AS confound_precision FROM rk""",
)


def evaluation_row(spark, sf):
    """Metrics, flagged share and the chain's largest gap of one proxy."""
    rows = confident.detect(chained(spark, sf))
    out = rows.agg(F.count("*").alias("n"), *ordinal.metrics(F.col("rating"), F.col("predicted_rating")), F.round(100.0 * F.count_if("is_noise") / F.count("*"), 6).alias("pct_flagged"))
    return out.crossJoin(cal.chain_gap(rows, "q_chain", "probs").select(F.round("gap_max", 9).alias("chain_gap_max")))  # one row each


_M = f"round(avg(abs(rating - predicted_rating)), 9) AS mae, round(sqrt(avg(((rating - predicted_rating) * (rating - predicted_rating))::DOUBLE)), 9) AS rmse, round(avg((rating = predicted_rating)::INT::DOUBLE), 9) AS accuracy, round(avg((abs(rating - predicted_rating) <= 1)::INT::DOUBLE), 9) AS off_by_one, round({ordinal.sql_qwk('rating', 'predicted_rating')}, 9) AS qwk, round(100.0::DOUBLE * count(*) FILTER (is_noise) / count(*), 6) AS pct_flagged"
add("evaluation_row", evaluation_row, f"{CL}, {CHAIN}, {GAPS} --> SELECT count(*) AS n, {_M}, (SELECT round(max(gap), 9) FROM gaps) AS chain_gap_max FROM de")


def flag_jaccard(spark, sf):
    f = confident.flags(scored(spark, sf))
    return confident.jaccard(f.where("confident_learning"), f.where("prune_by_noise_rate"))


add("flag_jaccard", flag_jaccard, f"{CL} --> SELECT count(*) FILTER (confident_learning AND prune_by_noise_rate) AS n_both, count(*) FILTER (confident_learning OR prune_by_noise_rate) AS n_any, round(count(*) FILTER (confident_learning AND prune_by_noise_rate) / nullif(count(*) FILTER (confident_learning OR prune_by_noise_rate), 0)::DOUBLE, 9) AS jaccard FROM fl")


# Models
add(
    "meanpool_embeddings",
    lambda s, d: table(s, d, "embeddings").select("vec_id", models.mean_pool("embedding", 16).alias("m")).select("vec_id", *(F.round(F.col("m")[i], 6).alias(f"m{i}") for i in range(4))),
    "SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(embedding[{16 * i + 1}:{16 * i + 16}], lambda x: x::DOUBLE)) / 16, 6) AS m{i}" for i in range(4)) + " FROM embeddings",
    "unused AS (SELECT 1)",
)


def embedded(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding", F.col("label").cast("int").alias("label"))


def rated(spark, sf):
    """The ten labels as five ratings of two each, in order."""
    return embedded(spark, sf).select("review_id", "embedding", (F.floor(F.col("label") / 2) + 1).cast("int").alias("rating"))


# All labels, each fold fitted; no SQL, so tests hold them against brute force.
add("proxy_lr_oof", lambda s, d: models.oof_logistic(embedded(s, d), CV_FOLDS, 10).select("review_id", "label", "fold", cal.argmax(F.col("probs")).alias("predicted")))
add("corn_binary_lr_oof", lambda s, d: models.oof_scaled(embedded(s, d), CV_FOLDS, 10, ordinal=True)[0].select("review_id", "label", "fold", cal.rank_decode(F.col("q_chain")).alias("predicted")))


def oof_store(spark, sf):
    """The stored out-of-fold rows of the rated embeddings, shared by all queries on them."""
    return OofStore(store_path(spark, "oof", sf))


add("ablation_table", lambda s, d: proxies.proxy_ablation(rated(s, d), provider=oof_store(s, d).get))
add("k_sensitivity", lambda s, d: proxies.k_table(proxies.predictions_by_k(rated(s, d), provider=oof_store(s, d).get)))
add("k_sensitivity_qwk_pairs", lambda s, d: proxies.paired_qwk(proxies.predictions_by_k(rated(s, d), provider=oof_store(s, d).get), N_BOOT))


def oof_folds(spark, sf):
    """A row for each stored fold of P4 with five folds: rows, temperature and losses of its inner hold-out."""
    store = oof_store(spark, sf)
    store.get(rated(spark, sf).withColumn("label", F.col("rating") - 1), models.FINAL_PROXY)
    return store.progress(spark).where("proxy = 'P4' and k = 5").drop("seconds")


add("oof_folds", oof_folds)


def quality_gate(spark, sf):
    """Gates over the clean table, its split, the probabilities and the variants, as one table."""
    clean = preprocess.first_of_text_and_rating(preprocess.clean_reviews(reviews(spark, sf), elongation=False))
    rows = splitting.split_rows(clean, splitting.grouped_split(clean, 42, text="cleaned_text"), "cleaned_text")
    parts = [checks.clean_table(clean), checks.split_table(rows, splitting.overlaps(rows, ("cleaned_text", "review_id"))), checks.probabilities(scored(spark, sf)), checks.variants(variants(spark, sf))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CHECKS = [("clean", "has rows"), ("clean", "no blank text"), ("clean", "no pure duplicate"), ("clean", "ids are unique"), ("split", "three parts"), ("split", "every row has a part"), ("split", "six overlaps are zero"), ("proxy", "five classes"), ("proxy", "sums to one"), ("variants", "hard <= severe <= raw")]
add("quality_gate", quality_gate, "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', TRUE, 'error')" for a, b in CHECKS) + ") v(section, \"check\", ok, severity)", "unused AS (SELECT 1)")

QUERIES, ORACLES = R.queries, R.oracles
