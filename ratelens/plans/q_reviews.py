"""Queries over the review table: profile, cleaning, duplicates, splits, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.functions.rng import h, sql_h, sql_u, u01
from ratelens.operators import preprocess, profile, splitting
from ratelens.operators.lineage import ids_hash
from ratelens.plans.config import CV_SEED, MAIN_SPLIT_SEED, QUOTAS
from ratelens.plans.fixtures import REVIEWS_SQL, SLANG, reviews
from ratelens.plans.registry import Registry
from ratelens.sources.tables import lexicon, quota_rows, table

R = Registry(REVIEWS_SQL)
add = R.add

TOKENS = "list_filter(regexp_split_to_array({0}, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')"
LENGTHS = f"lengths AS (SELECT *, len({TOKENS.format('coalesce(review_text, chr(32))')}) AS n_words FROM reviews)"


def lengths(spark, sf):
    return profile.with_lengths(reviews(spark, sf))


# Randomness
add(
    "hash_uniform",
    lambda s, d: reviews(s, d).select("review_id", h("t", F.col("review_id")).alias("h"), u01(42, F.col("review_id")).alias("u")),
    f"SELECT review_id, {sql_h(repr('t'), 'review_id')} AS h, {sql_u('42', 'review_id')} AS u FROM reviews",
)
FOLD = f"((row_number() OVER (PARTITION BY rating ORDER BY md5(concat_ws('|', {CV_SEED}, review_id)), review_id) - 1 + rating) % {{k}})::INT"
add(
    "stratified_kfold",
    lambda s, d: splitting.stratified_kfold(reviews(s, d).select("review_id", "rating"), 5, CV_SEED),
    f"SELECT review_id, rating, {FOLD.format(k=5)} AS fold FROM reviews",
)
add(
    "exact_stratified_sample",
    lambda s, d: splitting.exact_sample(reviews(s, d).select("review_id", "rating"), 20, 42, ("rating",)),
    "SELECT review_id, rating FROM reviews QUALIFY row_number() OVER (PARTITION BY rating ORDER BY md5(concat_ws('|', 42, review_id)), review_id) <= 20",
)

# Profile
add("rating_distribution", lambda s, d: profile.rating_distribution(reviews(s, d)), "SELECT rating, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM reviews WHERE rating IS NOT NULL GROUP BY rating")
add(
    "rating_by_app_pivot",
    lambda s, d: profile.rating_by_app(reviews(s, d)),
    "SELECT source_app, " + ", ".join(f"count(*) FILTER (rating = {r}) AS n_{r}" for r in range(1, 6)) + " FROM reviews WHERE source_app IS NOT NULL GROUP BY source_app",
)
SPAN = """span AS (SELECT source_app, rating, count(*) AS n, min(date) AS first_date, max(date) AS last_date,
  round(quantile_cont(date_diff('day', DATE '1970-01-01', date)::DOUBLE, 0.5), 6) AS median_day, date_diff('day', min(date), max(date)) AS span_days FROM reviews WHERE date IS NOT NULL GROUP BY source_app, rating)"""
add("date_span", lambda s, d: profile.date_span(reviews(s, d)), f"{SPAN} --> SELECT * FROM span")
add(
    "temporal_confound",
    lambda s, d: profile.temporal_confound(reviews(s, d)),
    f"{SPAN} --> SELECT source_app, arg_max(rating, span_days * 10 - rating) AS longest_rating, arg_min(rating, span_days * 10 + rating) AS shortest_rating, max(span_days) - min(span_days) AS difference_days FROM span GROUP BY source_app",
)
add(
    "text_length_describe",
    lambda s, d: profile.describe_lengths(lengths(s, d)),
    f"{LENGTHS} --> SELECT count(*) AS n, round(avg(n_words), 6) AS mean, round(stddev_samp(n_words), 6) AS std, min(n_words)::DOUBLE AS min, max(n_words)::DOUBLE AS max, "
    + ", ".join(f"round(quantile_cont(n_words::DOUBLE, {x}), 6) AS p{int(100 * x)}" for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    + " FROM lengths",
)
add(
    "length_by_rating",
    lambda s, d: profile.lengths_by_rating(lengths(s, d)),
    f"{LENGTHS} --> SELECT rating, count(*) AS n, round(avg(n_words), 6) AS mean, round(quantile_cont(n_words::DOUBLE, 0.5), 6) AS median, round(stddev_samp(n_words), 6) AS std FROM lengths GROUP BY rating",
)
add(
    "short_text_share",
    lambda s, d: profile.short_share(lengths(s, d)),
    f"{LENGTHS} --> SELECT rating, count(*) FILTER (n_words <= 3) AS n_short, count(*) AS n, round(CASE WHEN count(*) FILTER (n_words <= 3) > 0 THEN 100.0::DOUBLE * count(*) FILTER (n_words <= 3) / count(*) END, 6) AS pct_short FROM lengths GROUP BY rating",
)
add("length_histogram", lambda s, d: profile.length_histogram(lengths(s, d)), f"{LENGTHS} --> SELECT least(floor(least(n_words, 100) * 50 / 100.0), 49)::INT AS bin, count(*) AS n FROM lengths GROUP BY 1")
DUPS = "dups AS (SELECT review_text, count(*) AS n FROM reviews WHERE review_text IS NOT NULL GROUP BY review_text HAVING count(*) > 1)"
add("duplicate_groups", lambda s, d: profile.duplicate_groups(reviews(s, d)), f"{DUPS} --> SELECT * FROM dups")
add(
    "duplicate_summary",
    lambda s, d: profile.duplicate_summary(reviews(s, d)),
    f"{DUPS} --> SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows, round(100.0::DOUBLE * coalesce(sum(n), 0) / (SELECT count(*) FROM reviews), 6) AS pct_rows FROM dups",
)
add("duplicate_top200", lambda s, d: profile.top_duplicates(reviews(s, d)), f"{DUPS} --> SELECT * FROM dups ORDER BY n DESC, review_text LIMIT 200")
CONF = "conf AS (SELECT review_text, count(*) AS n, (max(rating) - min(rating))::INT AS spread FROM reviews WHERE review_text IS NOT NULL GROUP BY review_text HAVING count(DISTINCT rating) > 1)"
add("conflict_groups", lambda s, d: profile.conflict_groups(reviews(s, d)), f"{CONF} --> SELECT * FROM conf")
add("conflict_spread", lambda s, d: profile.conflict_spread(reviews(s, d)), f"{CONF} --> SELECT spread, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM conf GROUP BY spread")
add(
    "conflict_examples",
    lambda s, d: profile.conflict_examples(reviews(s, d)),
    f"{CONF} --> SELECT review_text, rating, review_id FROM reviews WHERE review_text IN (SELECT review_text FROM conf) QUALIFY row_number() OVER (PARTITION BY review_text ORDER BY rating, review_id) <= 5 ORDER BY review_text, rating, review_id LIMIT 40",
)
add(
    "lang_marker",
    lambda s, d: profile.language_markers(reviews(s, d), "fr"),
    "SELECT source_app, count(*) AS n, count(*) FILTER (detected_lang = 'fr') AS n_marked, round(100.0::DOUBLE * count(*) FILTER (detected_lang = 'fr') / count(*), 6) AS pct_marked FROM reviews GROUP BY source_app",
)
add(
    "random_split_leak",
    lambda s, d: profile.naive_split_leak(reviews(s, d), 0.2, 42),
    """parted AS (SELECT review_text, row_number() OVER (PARTITION BY rating ORDER BY md5(concat_ws('|', 42, review_id)), review_id) <= round_even(count(*) OVER (PARTITION BY rating) * 0.2::DOUBLE, 0) AS is_test FROM reviews WHERE review_text IS NOT NULL),
by_text AS (SELECT review_text, count(*) FILTER (is_test) AS te, count(*) FILTER (NOT is_test) AS tr FROM parted GROUP BY review_text)
--> SELECT sum(te)::BIGINT AS n_test, coalesce(sum(te) FILTER (tr > 0), 0)::BIGINT AS n_leaked, round(100.0::DOUBLE * coalesce(sum(te) FILTER (tr > 0), 0) / sum(te), 6) AS pct_leaked FROM by_text""",
)

# Cleaning
URL_SQL = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), 'http[^\\t\\n\\x0B\\f\\r ]+|www[^\\t\\n\\x0B\\f\\r ]+', '', 'g'), '@[\\p{{L}}\\p{{N}}_]+', '', 'g')"


def _emoji_sql(expr: str) -> str:
    for e, word in tx.EMOJI_WORDS.items():
        expr = f"replace({expr}, '{e}', ' {word} ')"
    return f"regexp_replace({expr}, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{1F1E6}}-\\x{{1F1FF}}\\x{{2190}}-\\x{{21FF}}\\x{{FE0F}}]+', ' ', 'g')"


def _marks_sql(expr: str) -> str:
    for mark in "!?.,":
        expr = f"regexp_replace({expr}, '[{mark}]{{2,}}', '{mark}', 'g')"
    return expr


SPACES = "'[\\t\\n\\x0B\\f\\r ]+'"
#: Without back-references a repeated character is one that equals the two before it, in a list of characters.
SHORTENED = "array_to_string(list_filter(chars, lambda c, i: i < 3 OR c = chr(10) OR c <> chars[i - 1] OR c <> chars[i - 2]), '')"
CLEANED = f"""f0 AS (SELECT *, string_split({_emoji_sql(URL_SQL.format('review_text'))}, '') AS chars FROM reviews WHERE review_text IS NOT NULL), f1 AS (SELECT * EXCLUDE (chars), {SHORTENED} AS folded FROM f0),
c0 AS (SELECT * EXCLUDE (folded), trim(regexp_replace({_marks_sql('folded')}, {SPACES}, ' ', 'g')) AS cleaned_text FROM f1),
cleaned AS (SELECT *, len({TOKENS.format('cleaned_text')})::INT AS n_words, len({TOKENS.format('cleaned_text')}) <= 3 AS is_very_short FROM c0 WHERE cleaned_text <> '')"""
KEPT = ("review_id", "rating", "cleaned_text", "n_words", "is_very_short")


def cleaned(spark, sf):
    """All steps of the cleaning but the lexicon."""
    return preprocess.clean_reviews(reviews(spark, sf))


add("text_clean_sqlsafe", lambda s, d: cleaned(s, d).select(*KEPT), f"{CLEANED} --> SELECT {', '.join(KEPT)} FROM cleaned")
SLANG_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SLANG.items()) + "}"
CORE = "^([^\\p{L}\\p{N}_]*)([\\p{L}\\p{N}_]+)([^\\p{L}\\p{N}_]*)$"
NORMALISED = f"""trim(array_to_string(list_transform({TOKENS.format('cleaned_text')}, lambda w: CASE WHEN regexp_matches(w, '{CORE}')
  THEN regexp_extract(w, '{CORE}', 1) || coalesce({SLANG_SQL}[regexp_extract(w, '{CORE}', 2)], regexp_extract(w, '{CORE}', 2)) || regexp_extract(w, '{CORE}', 3) ELSE w END), ' '))"""
add(
    "slang_normalise",
    lambda s, d: cleaned(s, d).select("review_id", tx.squeeze(tx.normalise_tokens(F.col("cleaned_text"), SLANG)).alias("normalised")),
    f"{CLEANED} --> SELECT review_id, {NORMALISED} AS normalised FROM cleaned",
)
add(
    "text_clean_full",
    lambda s, d: preprocess.clean_reviews(reviews(s, d), SLANG).select(*KEPT),
    f"{CLEANED}, full_ AS (SELECT review_id, rating, {NORMALISED} AS cleaned_text FROM cleaned) --> SELECT *, len({TOKENS.format('cleaned_text')})::INT AS n_words, len({TOKENS.format('cleaned_text')}) <= 3 AS is_very_short FROM full_ WHERE cleaned_text <> ''",
)
add(
    "slang_coverage",
    lambda s, d: preprocess.slang_coverage(reviews(s, d), SLANG),
    f"""t AS (SELECT unnest(list_filter(list_transform({TOKENS.format("lower(coalesce(review_text, ''))")}, lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '')) AS w FROM reviews)
--> SELECT count(*) AS n_tokens, count(*) FILTER (w IN ({", ".join(repr(k) for k in SLANG)})) AS n_known, round(coalesce(100.0::DOUBLE * count(*) FILTER (w IN ({", ".join(repr(k) for k in SLANG)})) / nullif(count(*), 0), 0), 6) AS pct_known FROM t""",
)


def _lexicon(spark, sf):
    base = table(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("slang"), F.lower("n_name").alias("formal"))
    domain = table(spark, sf, "region").select(F.lower(F.substring("r_name", 1, 3)).alias("slang"), F.lower("r_name").alias("formal"))
    return lexicon(base, domain)


add(
    "slang_lexicon",
    _lexicon,
    """both_ AS (SELECT lower(substr(n_name, 1, 3)) AS slang, lower(n_name) AS formal, 'base' AS origin, 0 AS r FROM nation UNION ALL SELECT lower(substr(r_name, 1, 3)), lower(r_name), 'domain', 1 FROM region)
--> SELECT slang, formal, origin FROM both_ WHERE slang IS NOT NULL AND formal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slang ORDER BY r DESC, formal DESC) = 1""",
)
add(
    "dedup_text_rating",
    lambda s, d: preprocess.first_of_text_and_rating(cleaned(s, d)).select("review_id", "rating"),
    f"{CLEANED} --> SELECT review_id, rating FROM cleaned QUALIFY row_number() OVER (PARTITION BY cleaned_text, rating ORDER BY review_id) = 1",
)
add(
    "conflict_resolution",
    lambda s, d: preprocess.resolve_conflicts(cleaned(s, d)).select("review_id", "rating"),
    f"""{CLEANED}, per AS (SELECT cleaned_text, rating, count(*) AS n FROM cleaned GROUP BY 1, 2),
top AS (SELECT cleaned_text, rating FROM per QUALIFY n = max(n) OVER (PARTITION BY cleaned_text)), one AS (SELECT cleaned_text, min(rating) AS rating FROM top GROUP BY 1 HAVING count(*) = 1)
--> SELECT review_id, cleaned.rating FROM cleaned JOIN one ON cleaned.cleaned_text = one.cleaned_text AND cleaned.rating = one.rating""",
)
add(
    "preprocess_summary",
    lambda s, d: preprocess.preprocess_summary(reviews(s, d), cleaned(s, d)),
    f"""{CLEANED}, per AS (SELECT cleaned_text, count(*) AS n, count(DISTINCT rating) AS k FROM cleaned GROUP BY 1)
--> SELECT (SELECT count(*) FROM reviews) AS n_raw, (SELECT count(*) FROM reviews WHERE review_text IS NULL) AS n_null, sum(n)::BIGINT AS n_cleaned, sum(k)::BIGINT AS n_after_dedup,
  count(*) FILTER (k > 1) AS n_conflict_groups, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS n_conflict_rows, (SELECT count(*) FROM cleaned WHERE is_very_short) AS n_very_short FROM per""",
)
add("token_truncation", lambda s, d: preprocess.truncation(reviews(s, d), tx.word_count(F.col("review_text"))), f"{LENGTHS} --> SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (n_words > 128) / count(*), 6) AS pct_truncated, floor(quantile_cont(n_words::DOUBLE, 0.5))::BIGINT AS median_len FROM lengths")
add(
    "language_marks",
    lambda s, d: preprocess.mark_languages(reviews(s, d).select("review_id", "review_text", "detected_lang"), F.col("detected_lang"), language="en").select("review_id", "detected_lang"),
    "m AS (SELECT review_id, CASE WHEN length(trim(coalesce(review_text, ''))) < 3 THEN 'undetected_short' ELSE detected_lang END AS detected_lang FROM reviews) --> SELECT * FROM m WHERE detected_lang IN ('undetected_short', 'en')",
)
add(
    "scrape_quota",
    lambda s, d: quota_rows(reviews(s, d).select("review_id", "source_app", "rating"), QUOTAS),
    "SELECT review_id, source_app, rating FROM reviews QUALIFY row_number() OVER (PARTITION BY source_app, rating ORDER BY review_id) <= CASE rating " + " ".join(f"WHEN {k} THEN {v}" for k, v in QUOTAS.items()) + " ELSE 0 END",
)

# Splits
MAJORITY = """counts AS (SELECT review_text, rating, count(*) AS n FROM reviews WHERE review_text IS NOT NULL GROUP BY 1, 2),
majority AS (SELECT review_text, rating AS majority, sum(n) OVER (PARTITION BY review_text)::BIGINT AS n_rows FROM counts QUALIFY row_number() OVER (PARTITION BY review_text ORDER BY n DESC, rating) = 1)"""
SPLIT = f"""{MAJORITY}, placed AS (SELECT *, row_number() OVER (PARTITION BY majority ORDER BY md5(concat_ws('|', {MAIN_SPLIT_SEED}, md5(review_text))), review_text) AS nth, count(*) OVER (PARTITION BY majority) AS n FROM majority),
cut AS (SELECT *, round_even(n * {1 - 0.2 - 0.1}::DOUBLE, 0) AS train FROM placed),
parts AS (SELECT review_text, majority, n_rows, CASE WHEN nth <= train THEN 'train' WHEN nth <= train + round_even((n - train) * 0.1::DOUBLE / {0.2 + 0.1}::DOUBLE, 0) THEN 'val' ELSE 'test' END AS part FROM cut),
placed_rows AS (SELECT reviews.*, parts.part FROM reviews JOIN parts USING (review_text))"""


def split_rows(spark, sf):
    r = reviews(spark, sf)
    return splitting.split_rows(r, splitting.grouped_split(r, MAIN_SPLIT_SEED))


add("majority_label", lambda s, d: splitting.majority_label(reviews(s, d)), f"{MAJORITY} --> SELECT * FROM majority")
add("grouped_split", lambda s, d: splitting.grouped_split(reviews(s, d), MAIN_SPLIT_SEED), f"{SPLIT} --> SELECT * FROM parts")
add(
    "split_summary",
    lambda s, d: splitting.split_summary(split_rows(s, d)),
    f"{SPLIT}, m AS (SELECT *, count(*) OVER (PARTITION BY review_text) AS repeats FROM placed_rows) --> SELECT part, count(*) AS n, count(*) FILTER (repeats > 1) AS n_repeated, "
    + ", ".join(f"round(avg((rating = {r})::INT::DOUBLE), 6) AS share_{r}" for r in range(1, 6))
    + ", round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM m GROUP BY part",
)
PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]
add(
    "split_overlap",
    lambda s, d: splitting.overlaps(split_rows(s, d), ("review_text", "review_id")),
    f"{SPLIT} --> " + " UNION ALL ".join(f"SELECT '{k}' AS key, '{a}' AS part_a, '{b}' AS part_b, (SELECT count(*) FROM (SELECT {k} FROM placed_rows WHERE part = '{a}' INTERSECT SELECT {k} FROM placed_rows WHERE part = '{b}')) AS n" for k in ("review_text", "review_id") for a, b in PAIRS),
)
add(
    "inner_calibration_split",
    lambda s, d: splitting.inner_holdout(splitting.stratified_kfold(reviews(s, d).select("review_id", "rating"), 5, CV_SEED), 5, CV_SEED),
    f"""f AS (SELECT review_id, rating, {FOLD.format(k=5)} AS fold FROM reviews), o AS (SELECT i::INT AS outer_, f.* FROM f, range(5) t(i) WHERE i <> fold)
--> SELECT outer_ AS outer, review_id, rating, row_number() OVER (PARTITION BY outer_, rating ORDER BY md5(concat_ws('|', {CV_SEED}, outer_, review_id)), review_id) <= round_even(count(*) OVER (PARTITION BY outer_, rating) * 0.1::DOUBLE, 0) AS is_calibration FROM o""",
)
add(
    "id_set_hash",
    lambda s, d: ids_hash(reviews(s, d)),
    "SELECT count(*) AS n, sha256(string_agg(review_id::VARCHAR, chr(10) ORDER BY review_id::VARCHAR)) AS sha256 FROM reviews",
)

QUERIES, ORACLES = R.queries, R.oracles
