"""Language detector and the profile's summary against direct computation."""

import collections
import math

from pyspark.sql import functions as F

from ratelens.operators import language, profile
from ratelens.plans.fixtures import reviews


def test_detector_against_direct_counts(spark):
    fit = [(1, "abcabc", "x"), (2, "ABCD", "x"), (3, "zzzyz", "y"), (4, "", "y"), (5, None, "x"), (6, "abz", None)]
    rows = fit + [(7, "  a ", None), (8, "abc zz", None), (9, "qqqq", None), (10, "zyzzy", None)]
    schema = "review_id long, review_text string, detected_lang string"
    counts = collections.defaultdict(collections.Counter)
    for _, t, lang in fit:
        if t and lang:
            counts[lang].update(t.lower()[i : i + 3] for i in range(len(t) - 2))
    kept = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:3]}
    weight = {(g, lang): math.log((c[g] + 1) / (sum(c.values()) + len(kept))) for lang, c in counts.items() for g in kept}
    model = language.fit(spark.createDataFrame(fit, schema), most=3)
    assert {(r.gram, r.lang): round(r.weight, 9) for r in model.collect()} == {k: round(v, 9) for k, v in weight.items()}
    got = {r.review_id: r.lang_pred for r in language.detect(spark.createDataFrame(rows, schema), model).collect()}
    for i, t, _ in rows:
        if t is None or len(t.strip(" ")) < 3:
            assert got[i] == language.SHORT
            continue
        grams = [t.lower()[k : k + 3] for k in range(len(t) - 2) if t.lower()[k : k + 3] in kept]
        want = min(counts, key=lambda lang: (-round(sum(weight[g, lang] for g in grams), 6), lang)) if grams else language.NONE
        assert got[i] == want


def test_detector_against_the_stored_languages(spark):
    rows = reviews(spark, "/root/testdata/sf0.01").select("review_id", "review_text", "detected_lang")
    held = F.crc32(F.col("review_id").cast("string")) % 4 == 2
    got = language.detect(rows, language.fit(rows.where(~held))).join(rows.where(held), "review_id").where("lang_pred <> 'undetected_short' and detected_lang is not null")
    right, n = got.agg(F.count_if(F.col("lang_pred") == F.col("detected_lang")), F.count("*")).first()
    assert n > 100 and right / n > 0.97


def test_summary_of_few_rows(spark):
    schema = "review_id long, source_app string, review_text string, rating int, date date"
    rows = [(1, "a", "x y", 1), (2, "b", "x y", 2), (3, "a", "x y z w", 2), (4, "c", None, 3), (5, None, None, 3), (6, "a", "", 5)]
    df = spark.createDataFrame(rows, "review_id long, source_app string, review_text string, rating int").withColumn("date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("review_id").cast("int")))
    r = profile.summary(df).first()
    assert (r.n_rows, r.n_apps, r.n_null_texts, r.n_texts, r.n_copy_groups, r.n_copy_rows, r.n_conflict_groups) == (6, 3, 2, 3, 1, 2, 1)
    assert r.mean_words == 2.0 and r.pct_short == 50.0 and r.pct_3 == round(100 * 2 / 6, 6) and str(r.first_date) == "2026-01-02"
    none = profile.summary(spark.createDataFrame([], schema)).first()
    assert none.n_rows is None and none.n_texts == 0
    plan = profile.summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_no_row_is_made_for_a_trigram(spark, monkeypatch):
    """Texts are counted and scored in pieces where they are; characters beyond 16 bits are single ones."""
    texts = ["ab\U0001f600ab\U0001f600", "\U0001f600\U0001f600\U0001f600\U0001f600", "İxßy" * 9, "ab", "abcdefgh" * 5, None]
    df = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "review_id long, review_text string, detected_lang string")
    lowered = [r[0] for r in df.select(F.lower("review_text")).collect()]
    want = collections.defaultdict(collections.Counter)
    for i, t in enumerate(lowered):
        if t and len(texts[i]) >= 3:
            want["xy"[i % 2]].update(t[k : k + 3] for k in range(len(t) - 2))
    whole = language.fit(df)
    rows = whole.collect()
    size = len({r.gram for r in rows})
    assert size == len({g for c in want.values() for g in c})
    assert all(math.isclose(r.weight, math.log((want[r.lang][r.gram] + 1) / (sum(want[r.lang].values()) + size))) for r in rows)
    found = language.detect(df, whole)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    monkeypatch.setattr(language, "PIECE", 4)
    assert [int(c) for x in language._codes(texts[4]) for c in x] == [language._code(texts[4][k : k + 3]) for k in range(38)]
