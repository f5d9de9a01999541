"""Queries over joined annotations, JSON, sub-word tokens, gates that fail, and stored training runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions import tokens
from ratelens.functions.rng import h, sql_h
from ratelens.operators import agreement, cells, checks, confident, language, preprocess, profile, significance, splitting
from ratelens.operators.oof_store import OofStore, lineage
from ratelens.operators.training import UNIT, Trainer, log_table, training_rows
from ratelens.plans.config import BOOT_SEED, HYPOTHESES, N_BOOT, SPLIT_SEEDS
from ratelens.plans.fixtures import ANNOTATIONS_SQL, PREDICTIONS_SQL, REVIEWS_SQL, SCORED_SQL, annotations, predictions, reviews, scored
from ratelens.plans.q_labels import CL, rated
from ratelens.plans.q_reviews import TOKENS
from ratelens.plans.q_statistics import WIDE
from ratelens.plans.registry import Registry
from ratelens.sources.store import store_path
from ratelens.sources.tables import json_column, table

R = Registry()
add = R.add
NONE = "unused AS (SELECT 1)"

# Annotators' files, each with its own rows, joined in the plan
FILES = f"""first AS (SELECT review_id, verdict FROM annotations), second AS (SELECT review_id, verdict_2 AS verdict FROM annotations WHERE verdict_2 IS NOT NULL),
retest AS (SELECT review_id, CASE WHEN {sql_h("'again'", "review_id")} % 4 = 0 THEN coalesce(verdict_2, 'ambiguous') ELSE verdict END AS verdict FROM annotations WHERE {sql_h("'retest'", "review_id")} % 10 = 0)"""


def files(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the first and second annotator and the retest filled in."""
    a, k = annotations(spark, sf), F.col("review_id")
    again = F.when(h("again", k) % 4 == 0, F.coalesce("verdict_2", F.lit("ambiguous"))).otherwise(F.col("verdict"))
    return a.select("review_id", "verdict"), a.where("verdict_2 is not null").select("review_id", F.col("verdict_2").alias("verdict")), a.where(h("retest", k) % 10 == 0).select("review_id", again.alias("verdict"))


def kappa_sql(other: str) -> str:
    return f"""{FILES}, pr AS (SELECT f.verdict AS a, o.verdict AS b FROM {other} o JOIN first f USING (review_id)), ag AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS po FROM pr),
ch AS (SELECT sum((SELECT count(*) FROM pr WHERE a = v) * (SELECT count(*) FROM pr WHERE b = v))::DOUBLE AS c FROM (VALUES ('noise'), ('not_noise'), ('ambiguous')) t(v))
--> SELECT n::BIGINT AS n, round(po, 9) AS observed, round((po - c / (n * n)) / nullif(1 - c / (n * n), 0), 9) AS kappa FROM ag, ch"""


add("annotator_kappa", lambda s, d: agreement.cohen_kappa(agreement.paired(*files(s, d)[:2]), "verdict_1", "verdict_2"), kappa_sql("second"), ANNOTATIONS_SQL)
add("retest_kappa", lambda s, d: agreement.cohen_kappa(agreement.paired(files(s, d)[0], files(s, d)[2], ("_first", "_retest")), "verdict_first", "verdict_retest"), kappa_sql("retest"), ANNOTATIONS_SQL)


def judged(spark, sf):
    """A sample of the flagged rows with its verdicts; distances come from the flagged rows by a join."""
    flagged = confident.detect(scored(spark, sf)).where("is_noise")
    sample = flagged.where(h("judged", F.col("review_id")) % 5 == 0).select("review_id").join(annotations(spark, sf).select("review_id", "verdict"), "review_id")
    return agreement.with_distance(sample, flagged)


add(
    "flagged_agreement",
    lambda s, d: agreement.agreement_by_distance(judged(s, d)),
    f"{CL} --> SELECT de.rating_diff, count(*) AS n, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (verdict = '{v}') / count(*), 6) AS pct_{v}" for v in agreement.VERDICTS) + f" FROM de JOIN annotations USING (review_id) WHERE is_noise AND {sql_h(repr('judged'), 'review_id')} % 5 = 0 GROUP BY 1",
    SCORED_SQL,
    ANNOTATIONS_SQL,
)

# Gold: effects of the stored predictions on a sample with gold labels
GOLD_N = 97


def gold_wide(spark, sf):
    """Wide predictions of the sampled reviews that have a gold label, against that label."""
    sample = splitting.proportional_sample(scored(spark, sf).select("review_id", "rating"), GOLD_N, 42, "rating").select("review_id")
    gold = agreement.gold_labels(annotations(spark, sf).join(sample, "review_id"))
    long = predictions(spark, sf).join(F.broadcast(gold), "review_id").withColumn("y_true", F.col("gold_rating"))  # at most GOLD_N rows
    return significance.wide_predictions(long)


_SAMPLE = f"""gsz AS (SELECT rating, count(*) AS n FROM scored GROUP BY 1), gex AS (SELECT rating, {GOLD_N}.0::DOUBLE * n / sum(n) OVER () AS e FROM gsz), gba AS (SELECT *, floor(e) AS b FROM gex),
gqt AS (SELECT rating, (b + (row_number() OVER (ORDER BY round(e - b, 9) DESC, rating) <= {GOLD_N} - sum(b) OVER ())::INT)::BIGINT AS quota FROM gba),
gsa AS (SELECT review_id FROM scored JOIN gqt USING (rating) QUALIFY row_number() OVER (PARTITION BY scored.rating ORDER BY md5(concat_ws('|', 42, review_id)), review_id) <= any_value(quota) OVER (PARTITION BY scored.rating)),
gl AS (SELECT review_id, gold::INT AS g FROM annotations JOIN gsa USING (review_id) WHERE gold <> 'ND')"""
_GOLD_PREDICTIONS = PREDICTIONS_SQL.replace("predictions AS (", "all_predictions AS (") + ", predictions AS (SELECT scenario, weight_seed, review_id, g AS y_true, y_pred FROM all_predictions JOIN gl USING (review_id))"
_E = significance.error
_HYP = ", ".join(f"avg({_E(a)} - {_E(b)}) AS {n}" for n, a, b in HYPOTHESES)
_NAMES = ", ".join(n for n, _, _ in HYPOTHESES)
add(
    "gold_effects",
    lambda s, d: agreement.gold_effects(significance.mae_effects(gold_wide(s, d), N_BOOT)),
    f"""{WIDE}, nm AS (SELECT row_number() OVER (ORDER BY {sql_h("'bucket'", "review_id")} % {significance.BUCKETS}, review_id) - 1 AS pos, * FROM wide), nn AS (SELECT count(*) AS n FROM wide),
dg AS (SELECT r.i AS rep, b.i AS block, md5(concat_ws('|', {BOOT_SEED}, r.i, b.i)) AS d, n FROM nn, range({N_BOOT}) r(i), (SELECT unnest(range((n + 3) // 4)) AS i FROM nn) b),
dr AS (SELECT rep, floor(('0x' || substr(d, 8 * k.i + 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS pos FROM dg, range(4) k(i) WHERE block * 4 + k.i < n), rs AS (SELECT * FROM dr JOIN nm USING (pos)),
bt AS (SELECT rep, {_HYP} FROM rs GROUP BY rep), bl AS (UNPIVOT bt ON {_NAMES} INTO NAME hypothesis VALUE v), pt AS (SELECT {_HYP} FROM wide), pl AS (UNPIVOT pt ON {_NAMES} INTO NAME hypothesis VALUE diff),
ef AS (SELECT bl.hypothesis, round(any_value(diff), 9) AS diff, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM bl JOIN pl ON bl.hypothesis = pl.hypothesis GROUP BY 1)
--> SELECT *, CASE WHEN diff < 0 THEN 'A better' WHEN diff > 0 THEN 'B better' ELSE 'tie' END AS direction, ci_low <= 0 AND ci_high >= 0 AS crosses_zero FROM ef""",
    SCORED_SQL,
    ANNOTATIONS_SQL,
    _SAMPLE,
    _GOLD_PREDICTIONS,
)

# JSON: some objects of the events are cut short or hold another type
def cut_props(spark, sf):
    """The events, some of whose objects are cut short, hold a text in place of a number, or are empty."""
    at = h("cut", F.col("event_id")) % 17
    props = F.when(at == 0, F.expr("substring(props, 1, length(props) - 1)")).when(at == 1, F.lit('{"k": "many"}')).when(at == 2, F.lit("{}")).otherwise(F.col("props"))
    return table(spark, sf, "events").withColumn("props", props)


add(
    "event_props",
    lambda s, d: json_column(cut_props(s, d), "props", "k bigint").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("malformed").alias("n_malformed"), F.count("json.k").alias("n_k"), F.sum("json.k").alias("sum_k")),
    f"""ev AS (SELECT event_type, CASE {sql_h("'cut'", "event_id")} % 17 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN '{{"k": "many"}}' WHEN 2 THEN '{{}}' ELSE props END AS p FROM events),
pa AS (SELECT event_type, p IS NOT NULL AND p <> '{{}}' AND NOT regexp_matches(p, '^\\{{"k": -?[0-9]+\\}}$') AS bad, regexp_extract(p, '^\\{{"k": (-?[0-9]+)\\}}$', 1) AS k FROM ev)
--> SELECT event_type, count(*) AS n, count(*) FILTER (bad) AS n_malformed, count(*) FILTER (k <> '') AS n_k, sum(nullif(k, '')::BIGINT)::BIGINT AS sum_k FROM pa GROUP BY event_type""",
    NONE,
)

# Sub-word tokens
MOST_TOKENS = 128


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


add("subword_truncation", lambda s, d: preprocess.truncation(reviews(s, d), tokens.subword_count(F.col("review_text"), vocabulary(), special=2), MOST_TOKENS))
add(
    "token_arrays",
    lambda s, d: reviews(s, d).select("review_id", tokens.padded_tokens(F.col("review_text"), vocabulary(), MOST_TOKENS).alias("t")).select("review_id", F.size("t.ids").alias("width"), F.aggregate("t.mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"), F.hash("t.ids").alias("ids_hash")),
)
add(
    "masked_pool",
    lambda s, d: table(s, d, "embeddings")
    .select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4)).alias("v"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i < F.col("vec_id") % 17).cast("int")).alias("m"))
    .select("vec_id", tokens.masked_mean(F.col("v"), F.col("m")).alias("p"))
    .select("vec_id", *(F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(4))),
    "SELECT vec_id, " + ", ".join(f"round(coalesce(list_sum(list_transform(range(0, (vec_id % 17)), lambda t: embedding[t * 4 + {i + 1}]::DOUBLE)), 0) / greatest(vec_id % 17, 1), 6) AS p{i}" for i in range(4)) + " FROM embeddings",
    NONE,
)

# Gates over inputs of which some fail
PROFILE = ("rating_distribution", "text_length_describe", "duplicate_groups", "conflict_groups")


def failing_gates(spark, sf):
    """Gates over raw reviews, a split by rows, spoiled probabilities, missing tables, units and splits."""
    raw = reviews(spark, sf).select((F.col("review_id") - F.col("review_id") % 50 * (h("twin", F.col("review_id")) % 3 == 0).cast("int")).alias("review_id"), "rating", F.col("review_text").alias("cleaned_text"))
    part = F.when(h("part", F.col("review_id"), F.col("rating")) % 10 < 7, "train").when(h("part", F.col("review_id"), F.col("rating")) % 10 < 8, "val").otherwise("test")
    rows = raw.withColumn("part", part)
    spoiled = scored(spark, sf).withColumn("probs", F.when(h("spoil", F.col("review_id")) % 7 == 0, F.slice("probs", 1, 4)).otherwise(F.col("probs")))
    tables = reduce(DataFrame.unionByName, (table(spark, sf, t).agg(F.lit(n).alias("name"), F.count_if(F.lit(keep)).alias("n")) for n, t, keep in zip(PROFILE[:3], ("documents", "labels", "pages"), (True, False, True), strict=True)))
    done = predictions(spark, sf).select(F.explode(F.array(*(F.lit(x) for x in SPLIT_SEEDS))).alias("split_seed"), *UNIT, "review_id").where(~((F.col("split_seed") == 123) & (h("gone", F.col("scenario"), F.col("weight_seed")) % 4 == 0)))
    effects = done.where(F.col("split_seed") != 2024).select("split_seed").distinct()
    variants = predictions(spark, sf).select(F.when(F.col("weight_seed") == 42, "raw").when(F.col("weight_seed") == 123, "hard").otherwise("severe").alias("variant"), F.when(F.col("scenario") == "M1_Baseline_CE", "P3").otherwise("P4").alias("proxy")).distinct()
    proxies = done.select(F.when(F.col("weight_seed") == 42, "P4").otherwise("P1").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return checks.report(
        checks.clean_table(raw),
        checks.split_table(rows, splitting.overlaps(rows, ("cleaned_text", "review_id"))),
        checks.probabilities(spoiled),
        checks.profile(tables, PROFILE, ("scraping_summary",)),
        checks.ablation(proxies, ("P1", "P2", "P3", "P4"), variants),
        checks.gold(tables.withColumn("name", F.lit("gold_evaluation"))),
        checks.partitions(done, effects, SPLIT_SEEDS, 18),
    )


_PART = f"{sql_h(repr('part'), 'review_id', 'rating')} % 10"
_LINES = [
    ("clean", "has rows", "(SELECT count(*) > 0 FROM raw)"),
    ("clean", "no blank text", "(SELECT count(*) FILTER (trim(coalesce(cleaned_text, '')) = '') = 0 FROM raw)"),
    ("clean", "no pure duplicate", "(SELECT max(n) <= 1 FROM (SELECT count(*) AS n FROM raw GROUP BY cleaned_text, rating))"),
    ("clean", "ids are unique", "(SELECT max(n) <= 1 FROM (SELECT count(*) AS n FROM raw GROUP BY review_id))"),
    ("split", "three parts", "(SELECT count(DISTINCT part) = 3 FROM parted)"),
    ("split", "every row has a part", "(SELECT count(*) FILTER (part IS NULL) = 0 FROM parted)"),
    ("split", "six overlaps are zero", "(SELECT max(k) = 1 FROM (SELECT count(DISTINCT part) AS k FROM parted GROUP BY cleaned_text UNION ALL SELECT count(DISTINCT part) FROM parted GROUP BY review_id))"),
    ("proxy", "five classes", "(SELECT count(*) FILTER (NOT spoiled) > 0 FROM sp)"),
    ("proxy", "sums to one", "(SELECT max(abs(CASE WHEN spoiled THEN p1 + p2 + p3 + p4 ELSE p1 + p2 + p3 + p4 + p5 END - 1)) <= 1e-4 FROM sp)"),
    *(("profile", f"there: {n}", f"(SELECT count(*) {'> 0' if t in ('documents', 'pages') else '< 0'} FROM {t})") for n, t in zip(PROFILE[:3], ("documents", "labels", "pages"), strict=True)),
    ("profile", f"there: {PROFILE[3]}", "(SELECT count(*) FILTER (FALSE) > 0 FROM documents)"),
    ("profile", "there: scraping_summary", "(SELECT count(*) FILTER (FALSE) > 0 FROM documents)"),
    *(("ablation", f"there: {p}", f"(SELECT count(*) FILTER (CASE WHEN weight_seed = 42 THEN 'P4' ELSE 'P1' END = '{p}') > 0 FROM done)") for p in ("P1", "P2", "P3", "P4")),
    ("ablation", "variants come from the last proxy only", "(SELECT count(DISTINCT weight_seed) = 3 AND count(*) FILTER (scenario = 'M1_Baseline_CE') = 0 FROM predictions)"),
    ("gold", "there: gold_evaluation", "(SELECT count(*) > 0 FROM documents)"),
    *(("gold", f"there: {n}", "(SELECT count(*) FILTER (FALSE) > 0 FROM documents)") for n in ("gold_effects", "gold_undetermined")),
    *(("partitions", f"split {s}: all units", f"(SELECT count(DISTINCT (scenario, weight_seed)) FILTER (split_seed = {s}) = 18 FROM done)") for s in SPLIT_SEEDS),
    *(("partitions", f"split {s}: effects", f"(SELECT count(*) FILTER (split_seed = {s} AND split_seed <> 2024) > 0 FROM done)") for s in SPLIT_SEEDS),
]
add(
    "gate_failures",
    failing_gates,
    f"""raw AS (SELECT review_id - review_id % 50 * ({sql_h("'twin'", "review_id")} % 3 = 0)::INT AS review_id, rating, review_text AS cleaned_text FROM reviews),
parted AS (SELECT *, CASE WHEN {_PART} < 7 THEN 'train' WHEN {_PART} < 8 THEN 'val' ELSE 'test' END AS part FROM raw), sp AS (SELECT *, {sql_h("'spoil'", "review_id")} % 7 = 0 AS spoiled FROM scored),
done AS (SELECT split_seed, scenario, weight_seed FROM (SELECT DISTINCT scenario, weight_seed FROM predictions), (VALUES {", ".join(f"({s})" for s in SPLIT_SEEDS)}) x(split_seed) WHERE NOT (split_seed = 123 AND {sql_h("'gone'", "scenario", "weight_seed")} % 4 = 0))
--> """
    + " UNION ALL ".join(f"SELECT '{a}' AS section, '{b}' AS \"check\", {c} AS ok, '{'warning' if b.endswith('scraping_summary') else 'error'}' AS severity" for a, b, c in _LINES),
    REVIEWS_SQL,
    SCORED_SQL,
    PREDICTIONS_SQL,
)


# Predictions that don't fit the truth: lost, unknown and relabelled reviews
def misaligned(spark, sf):
    k = F.col("review_id")
    have = predictions(spark, sf).where(h("gap", F.col("weight_seed"), k) % 83 != 0)
    truth = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("y_true")).where(h("lost", k) % 97 != 0)
    return significance.alignment(have, truth.withColumn("y_true", F.when(h("other", k) % 89 == 0, F.col("y_true") % 5 + 1).otherwise(F.col("y_true"))))


add(
    "alignment_failures",
    misaligned,
    f"""hv AS (SELECT * FROM predictions WHERE {sql_h("'gap'", "weight_seed", "review_id")} % 83 <> 0),
tr AS (SELECT o_orderkey AS review_id, substr(o_orderpriority, 1, 1)::INT AS y, {sql_h("'other'", "o_orderkey")} % 89 = 0 AS other FROM orders WHERE {sql_h("'lost'", "o_orderkey")} % 97 <> 0),
wt AS (SELECT scenario, weight_seed, review_id, CASE WHEN other THEN y % 5 + 1 ELSE y END AS want FROM units, tr)
--> SELECT scenario, weight_seed, count(*) FILTER (y_true IS NULL) AS n_missing, count(*) FILTER (want IS NULL) AS n_unknown, count(*) FILTER (want <> y_true) AS n_other_label FROM wt FULL JOIN hv USING (scenario, weight_seed, review_id) GROUP BY 1, 2""",
    PREDICTIONS_SQL,
)


# Profile in one pass, language detection
_NW = f"len({TOKENS.format('review_text')})"
add(
    "profile_summary",
    lambda s, d: profile.summary(reviews(s, d)),
    f"""rw AS (SELECT *, CASE WHEN review_text IS NOT NULL THEN {_NW} END AS w FROM reviews), tx AS (SELECT review_text, count(*) AS n, count(DISTINCT rating) AS k FROM reviews WHERE review_text IS NOT NULL GROUP BY 1)
--> SELECT count(*) AS n_rows, count(DISTINCT source_app) AS n_apps, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (review_text IS NULL) AS n_null_texts, (SELECT count(*) FROM tx) AS n_texts,
  round(sum(w) / count(w)::DOUBLE, 6) AS mean_words, round(100.0::DOUBLE * count(*) FILTER (w <= 3) / count(*), 6) AS pct_short, (SELECT count(*) FILTER (n > 1) FROM tx) AS n_copy_groups, (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM tx) AS n_copy_rows,
  (SELECT count(*) FILTER (k > 1) FROM tx) AS n_conflict_groups, {", ".join(f"round(100.0::DOUBLE * count(*) FILTER (rating = {r}) / count(*), 6) AS pct_{r}" for r in range(1, 6))} FROM rw""",
    REVIEWS_SQL,
)


def detected(spark, sf):
    """Languages of all reviews by a model of those that a hash keeps for fitting."""
    rows = reviews(spark, sf).select("review_id", "review_text", "detected_lang")
    return language.detect(rows, language.fit(rows.where(h("fit", F.col("review_id")) % 4 != 2)))


add(
    "language_detect",
    detected,
    f"""rw AS (SELECT review_id, review_text AS t, detected_lang AS l, lower(review_text) AS lo, length(trim(coalesce(review_text, ''))) < 3 AS short FROM reviews),
ch AS (SELECT review_id, l, short, string_split(lo, '') AS c, length(t) AS n FROM rw WHERE length(t) >= 3), tg AS (SELECT review_id, l, short, unnest(list_transform(range(1, n - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM ch),
ct AS (SELECT l, g, count(*) AS n FROM tg WHERE l IS NOT NULL AND {sql_h("'fit'", "review_id")} % 4 <> 2 GROUP BY 1, 2), tt AS (SELECT l, sum(n) AS total FROM ct GROUP BY 1),
kp AS (SELECT DISTINCT g FROM (SELECT g, row_number() OVER (PARTITION BY l ORDER BY n DESC, g) AS nth FROM ct) WHERE nth <= 400),
md AS (SELECT kp.g, tt.l, ln((coalesce(ct.n, 0) + 1.0::DOUBLE) / (total + count(*) OVER (PARTITION BY tt.l))) AS w FROM kp CROSS JOIN tt LEFT JOIN ct ON ct.g = kp.g AND ct.l = tt.l),
sc AS (SELECT review_id, md.l, round(sum(w), 6) AS s FROM tg JOIN md USING (g) WHERE NOT short GROUP BY 1, 2), be AS (SELECT review_id, l FROM sc QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY s DESC, l) = 1)
--> SELECT rw.review_id, CASE WHEN short THEN 'undetected_short' ELSE coalesce(be.l, 'und') END AS lang_pred FROM rw LEFT JOIN be USING (review_id)""",
    REVIEWS_SQL,
)


# Training: log, checkpoints and predictions are stored, and read by all that follows
def trainer(spark, sf) -> Trainer:
    """The units of the main split over the rated embeddings; what is stored isn't trained again."""
    rows = rated(spark, sf)
    mark = lineage(rows, ("review_id", "rating", "embedding"))  # other rows under the same folder have another place
    made = Trainer(store_path(spark, "training", sf, mark), SPLIT_SEEDS[0])
    if made.todo(spark):
        store = OofStore(store_path(spark, "oof-train", sf, mark))
        made.run(training_rows(rows, made.split_seed, store.get))
    return made


add("training_log", lambda s, d: log_table(trainer(s, d), s))
add("trained_best_epoch", lambda s, d: significance.best_epoch(trainer(s, d).log(s), UNIT))
add("trained_last_epoch", lambda s, d: significance.early_stop(trainer(s, d).log(s), by=UNIT))
add("trained_results", lambda s, d: significance.results_table(trainer(s, d).predictions(s)))
add("trained_effects", lambda s, d: cells.effect_long(significance.wide_predictions(trainer(s, d).predictions(s)), N_BOOT, SPLIT_SEEDS[0]))

QUERIES, ORACLES = R.queries, R.oracles
