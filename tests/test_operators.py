import json

import pytest
from pyspark.sql import functions as F

from ratelens.operators import agreement, checks, confident, lineage, preprocess, significance, splitting
from ratelens.plans.fixtures import effects, predictions, reviews, scored
from ratelens.sources import tables
from ratelens.streaming.ingest import arrivals, cleaned_stream, write_batches


def test_conflicts_that_tie_drop(spark):
    rows = [(1, "a", 1), (2, "a", 5), (3, "b", 2), (4, "b", 2), (5, "b", 4), (6, "c", 3)]
    df = spark.createDataFrame(rows, "review_id int, cleaned_text string, rating int")
    assert sorted(r.review_id for r in preprocess.resolve_conflicts(df).collect()) == [3, 4, 6]
    pure = preprocess.first_of_text_and_rating(df)
    assert [r.cleaned_text for r in preprocess.resolve_conflicts(pure).collect()] == ["c"]


def test_split_sizes_leaks_and_seeds(spark, sf):
    r = reviews(spark, sf)
    parts = splitting.grouped_split(r, 42)
    rows = splitting.split_rows(r, parts).cache()
    n = {x.part: x["count"] for x in rows.groupBy("part").count().collect()}
    total = sum(n.values())
    assert total == r.count() and abs(n["train"] / total - 0.7) < 0.05 and abs(n["test"] / total - 0.2) < 0.05
    assert all(x.n == 0 for x in splitting.overlaps(rows, ("review_text", "review_id")).collect())
    other = splitting.grouped_split(r, 123)
    assert other.join(parts.where("part = 'test'"), ["review_text", "part"]).count() < n["test"]
    assert lineage.same_rows(parts, splitting.grouped_split(r.repartition(7), 42))


def test_noise_invariants(spark, sf):
    rows = confident.detect(scored(spark, sf)).cache()
    assert rows.where("is_noise_severe and not is_noise").isEmpty() and rows.where("is_noise_severe and rating_diff < 2").isEmpty()
    assert confident.noise_distance(rows).agg(F.sum("n_flagged")).first()[0] == rows.where("is_noise").count() > 0
    n = {r.variant: r.n for r in confident.variant_counts(rows).collect()}
    assert n["hard"] <= n["severe"] <= n["raw"]
    assert rows.where("confident_learning and predicted_rating = rating").isEmpty()
    for proxy, folds in (("P1", 5), ("P4", 10)):
        with pytest.raises(ValueError):
            confident.export_variants(rows, ["review_id"], proxy, folds)
    assert set(confident.export_variants(rows, ["review_id"])) == {"raw", "hard", "severe"}


def test_planted_label_errors_are_found(spark):
    rows = []
    for i in range(500):
        true = i % 5 + 1
        label = true % 5 + 1 if i % 10 == 0 else true
        rows.append((i, label, [0.92 if j == true else 0.02 for j in range(1, 6)]))
    df = spark.createDataFrame(rows, "review_id int, rating int, probs array<double>")
    found = {r.review_id for r in confident.flags(df).where("confident_learning").collect()}
    assert found == {i for i in range(500) if i % 10 == 0}


def test_jaccard(spark):
    a, b = spark.range(100).withColumnRenamed("id", "review_id"), spark.range(50, 150).withColumnRenamed("id", "review_id")
    assert confident.jaccard(a, b).first().jaccard == pytest.approx(1 / 3, abs=1e-8)
    assert confident.jaccard(a.where("false"), b.where("false")).first().jaccard is None


def test_verdicts(spark):
    got = {(r.hypothesis, r.metric): (r.verdict, r.direction) for r in significance.consistency(effects(spark)).collect()}
    assert got == {
        ("H1", "MAE"): ("consistent", "A"),
        ("H4", "MAE"): ("not consistent", "A"),
        ("H2", "MAE"): ("not consistent", "mixed"),
        ("H2", "QWK_ensemble"): ("consistent", "B"),
        ("H1", "QWK_per_seed"): ("not assessable", "B"),
    }


def test_signed_ranks_against_a_direct_ranking(spark):
    diffs = [0.0, 0.0, 1.0, -1.0, 2.0, 2.0, -3.0, 1.0, 0.5]
    df = spark.createDataFrame([("h", d) for d in diffs], "hypothesis string, d double").groupBy("hypothesis", "d").agg(F.count("*").alias("n"))
    order = sorted(abs(d) for d in diffs)
    rank = lambda d: sum(i + 1 for i, v in enumerate(order) if v == abs(d)) / order.count(abs(d))
    want = sum(rank(d) for d in diffs if d > 0) + sum(rank(d) for d in diffs if d == 0) / 2
    assert significance.wilcoxon(df).first().r_plus == want


def test_equal_models_have_no_effect(spark, sf):
    long = predictions(spark, sf)
    same = long.where("scenario = 'M1_Baseline_CE'").drop("scenario").crossJoin(long.select("scenario").distinct())
    wide = significance.wide_predictions(same).cache()
    for row in significance.mae_effects(wide, 5).collect() + significance.qwk_ensemble_effects(wide, 5).collect():
        assert (row.diff, row.ci_low, row.ci_high) == (0, 0, 0)
    assert all(r.p == 1.0 and not r.significant for r in significance.significance_table(wide).collect())


def test_effect_table_shape(spark, sf):
    table = significance.effect_table(significance.wide_predictions(predictions(spark, sf)), 5, 42).cache()
    assert table.count() == 15 and table.where("metric <> 'MAE' and p is not null").isEmpty()
    checks.assert_ok(checks.effects(table))


def test_misaligned_predictions_are_seen(spark, sf):
    long = predictions(spark, sf)
    truth = long.select("review_id", "y_true").distinct()
    broken = long.where("not (scenario = 'M1_Baseline_CE' and weight_seed = 42 and review_id % 2 = 0)")
    bad = significance.alignment(broken, truth).where("n_missing > 0").collect()
    assert [(r.scenario, r.weight_seed) for r in bad] == [("M1_Baseline_CE", 42)]


def test_gold_labels(spark):
    df = spark.createDataFrame([(1, "3"), (2, " nd "), (3, ""), (4, None), (5, "5")], "review_id int, gold string")
    assert sorted((r.review_id, r.gold_rating) for r in agreement.gold_labels(df).collect()) == [(1, 3), (5, 5)]
    with pytest.raises(Exception, match="gold label"):
        agreement.gold_labels(spark.createDataFrame([(1, "7")], "review_id int, gold string")).collect()
    assert agreement.gold_kappa(df.withColumn("gold_2", F.col("gold"))).first().kappa == 1


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "a.json")
    assert lineage.write_once_json({"a": 1}, path) == "written"
    assert lineage.write_once_json({"a": 1}, path) == "already there, identical"
    with pytest.raises(FileExistsError):
        lineage.write_once_json({"a": 2}, path)
    (tmp_path / "c (1).csv").write_text("x")
    with pytest.raises(ValueError):
        lineage.write_once_bytes(str(tmp_path / "c.csv"), b"x")
    df, table = spark.range(10), str(tmp_path / "t")
    assert lineage.write_once(df, table) == "written" and lineage.write_once(df.repartition(3), table) == "already there, identical"
    with pytest.raises(FileExistsError):
        lineage.write_once(spark.range(11), table)


def test_sidecars_and_annotations(spark, tmp_path):
    ids, side = spark.range(20).withColumnRenamed("id", "review_id"), str(tmp_path / "s.json")
    lineage.write_sidecar(ids, side, "sample")
    assert lineage.verify_sidecar(ids.repartition(4), side)["n_ids"] == 20
    with pytest.raises(ValueError):
        lineage.verify_sidecar(ids.where("review_id > 3"), side)
    empty = ids.withColumn("verdict", F.lit(" "))
    lineage.may_create(empty, "verdict")
    with pytest.raises(FileExistsError):
        lineage.may_create(empty.withColumn("verdict", F.lit("noise")), "verdict")
    assert agreement.unmatched(ids.where("review_id < 5"), ids).isEmpty() and agreement.unmatched(ids, ids.where("review_id < 5")).count() == 15


def test_run_context(tmp_path):
    ctx = lineage.RunContext(str(tmp_path), 123)
    with pytest.raises(ValueError):
        lineage.RunContext(str(tmp_path), 7)
    with pytest.raises(ValueError):
        ctx.require_main("ablation")
    assert ctx.weight_seeds(True) == (42,) and lineage.RunContext(str(tmp_path), 42).weight_seeds(True) == (42, 123, 2024)
    ctx.lock_mode(str(tmp_path), True)
    with pytest.raises(FileExistsError):
        ctx.lock_mode(str(tmp_path), False)
    assert ctx.predictions("M1", 42).endswith("split_seed=123/predictions/scenario=M1/weight_seed=42")


def test_files(spark, tmp_path):
    for name in ("runs/x.csv", "preserved/l.csv", "odd.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("a,b\n1,2\n")
    files = tables.files_as_table(spark, str(tmp_path))
    assert {r.kind: r.n for r in lineage.audit_files(files).collect()} == {"unexpected": 2, "preserved": 1}
    assert {r.kind: r.n for r in lineage.audit_files(files, "end").collect()} == {"unexpected": 1, "preserved": 1, "allowed": 1}
    assert all(len(r.sha256) == 64 for r in lineage.results_manifest(files).collect())
    assert {r.pattern: r.n for r in lineage.output_map(files, [("1", "%.csv"), ("2", "%.npz")]).collect()} == {"%.csv": 2, "%.npz": 0}
    assert lineage.export_zip(str(tmp_path), str(tmp_path / "b.zip")) == 2
    assert len(lineage.clean_artefacts(str(tmp_path))) == 1 and (tmp_path / "runs/x.csv").exists()
    with pytest.raises(ValueError):
        lineage.clean_artefacts(str(tmp_path), False, "yes")
    lock = tables.corpus_lock(spark, str(tmp_path / "odd.txt"), lineage.file_sha256(str(tmp_path / "odd.txt")), 1).first()
    assert lock.locked and not tables.corpus_lock(spark, str(tmp_path / "odd.txt"), "0", 1).first().locked
    assert lineage.is_duplicate_name("x (2).csv") and not lineage.is_duplicate_name("x_2.csv")
    assert lineage.version_tuple("2.10rc1") == (2, 10, 1)


def test_master_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('source_app,review_text,rating,date,review_id\nA,"two\nlines",5,2026-01-02,r1\nB,,x,soon,r2\n')
    rows = {r.review_id: r for r in tables.read_master(spark, str(path)).collect()}
    assert rows["r1"].rating == 5 and str(rows["r1"].date) == "2026-01-02" and rows["r1"].review_text == "two\nlines"
    assert rows["r2"].rating is None and rows["r2"].date is None and rows["r2"].review_text is None
    with pytest.raises(ValueError):
        tables.verified(spark.range(3), required=["text"])
    with pytest.raises(ValueError):
        tables.verified(spark.range(3), expected_rows=4)


def test_gates_report_all_failures(spark):
    bad = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, " ", 2)], "review_id int, cleaned_text string, rating int")
    failed = [r.check for r in checks.clean_table(bad).where("not ok").collect()]
    assert failed == ["no blank text", "no pure duplicate", "ids are unique"]
    with pytest.raises(AssertionError, match="no blank text; .*no pure duplicate"):
        checks.assert_ok(checks.clean_table(bad))


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    rows = [("r1", "Bagus!!! 😊", "A", 5, "2026-01-01 00:10:00"), ("r1", "again", "A", 5, "2026-01-01 00:20:00"), ("r2", " ", "A", 1, "2026-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "review_id string, review_text string, source_app string, rating int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    write_batches(cleaned_stream(stream), out, str(tmp_path / "cp")).awaitTermination(120)
    assert [r.cleaned_text for r in spark.read.parquet(out).collect()] in (["bagus! senang"], ["again"])
    assert arrivals(df, "1 hour").count() == 2


def test_manifest_json_is_stable(tmp_path):
    lineage.write_once_json({"b": 1, "a": 2}, str(tmp_path / "x.json"))
    assert list(json.loads((tmp_path / "x.json").read_text())) == ["a", "b"]
