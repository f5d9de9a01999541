"""Stored out-of-fold rows: fitted once, resumed by fold, guarded by their lineage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.operators import models, proxies
from ratelens.operators.oof_store import PARTITIONS, SCHEMA, LineageError, OofStore, lineage
from ratelens.sources.store import read_partitions, replace_partitions, store_path


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(11)
    rows = [(i, i % 5 + 1, i % 5, [float(i % 5 + r.normal()), float(r.normal()), float(r.normal()), 1.0]) for i in range(150)]
    return spark.createDataFrame(rows, "review_id long, rating int, label int, embedding array<double>").cache()


def _rows(df):
    return sorted((r.review_id, r.label, r.fold, [round(p, 12) for p in r.probs], r.q_chain and [round(q, 12) for q in r.q_chain]) for r in df.collect())


def test_second_run_fits_nothing_and_gives_the_same(spark, points, tmp_path, monkeypatch):
    first = OofStore(f"file://{tmp_path}/oof")
    oof, temperatures = first.get(points, models.FINAL_PROXY, 3)
    direct, wanted = models.proxy_oof(points, models.FINAL_PROXY, 3)
    assert _rows(oof) == _rows(direct) and temperatures == dict(wanted)
    assert set(oof.columns) == set(direct.columns)
    assert first.fitted == [("P4", 3, (0, 1, 2))]
    monkeypatch.setattr(models, "proxy_oof", lambda *a, **b: pytest.fail("fitted again"))
    again = OofStore(first.path)
    assert _rows(again.get(points, models.FINAL_PROXY, 3)[0]) == _rows(direct) and again.fitted == []
    facts = again.progress(spark).collect()
    assert sorted((r.proxy, r.k, r.fold) for r in facts) == [("P4", 3, i) for i in range(3)]
    assert sum(r.n for r in facts) == 150 and all(r.nll_after <= r.nll_before + 1e-9 and r.seconds > 0 for r in facts)


def test_unfinished_folds_alone_are_fitted(spark, points, tmp_path):
    store = OofStore(f"file://{tmp_path}/oof")
    whole = _rows(store.get(points, 2)[0].withColumn("q_chain", F.lit(None)))
    rows = read_partitions(spark, store.path, SCHEMA).where("fold <> 3 and (fold <> 1 or review_id % 2 = 0)").collect()  # one fold lost, one in part
    other = OofStore(f"file://{tmp_path}/torn")
    replace_partitions(spark.createDataFrame(rows, read_partitions(spark, store.path, SCHEMA).schema), other.path, PARTITIONS)
    assert _rows(other.get(points, 2)[0].withColumn("q_chain", F.lit(None))) == whole
    assert other.fitted == [("P3", 5, (1, 3))]


def test_calibrated_regressions_resume_too(spark, points, tmp_path):
    part = models.proxy_oof(points, 0, only=[1, 4])[0]
    whole = models.proxy_oof(points, 0)[0].where("fold in (1, 4)")
    assert _rows(part.withColumn("q_chain", F.lit(None))) == _rows(whole.withColumn("q_chain", F.lit(None)))


def test_other_training_rows_are_refused(spark, points, tmp_path):
    store = OofStore(f"file://{tmp_path}/oof")
    store.get(points, 2)
    for other in (points.where("review_id <> 7"), points.withColumn("label", (F.col("label") + (F.col("review_id") == 3).cast("int")) % 5)):
        with pytest.raises(LineageError):
            store.get(other, 2)
    assert lineage(points) == lineage(points.repartition(7).orderBy(F.desc("review_id")))


def test_reads_only_its_partitions(spark, points, tmp_path):
    store = OofStore(f"file://{tmp_path}/oof")
    store.get(points, 2)
    store.get(points, 3, 3)
    plan = store.rows(points, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(proxy" in plan and "(k" in plan


def test_nothing_to_fit(spark, points, tmp_path):
    store = OofStore(f"file://{tmp_path}/oof")
    assert store.get(points.limit(0), 2)[0].count() == 0


def test_tables_share_the_stored_rows(spark, points, tmp_path):
    store = OofStore(f"file://{tmp_path}/oof")
    rows = points.drop("label")
    table = proxies.proxy_ablation(rows, (2, 3), provider=store.get).collect()
    by_k = proxies.predictions_by_k(rows, (3, 5), provider=store.get)
    assert proxies.k_table(by_k).count() == 2 and len(table) == 2
    assert sorted(store.fitted) == [("P3", 5, (0, 1, 2, 3, 4)), ("P4", 3, (0, 1, 2)), ("P4", 5, (0, 1, 2, 3, 4))]
    fresh = proxies.proxy_ablation(rows, (2, 3)).collect()
    assert [r.asDict() for r in table] == [r.asDict() for r in fresh]


def test_places_are_stable_and_differ_by_key(spark):
    assert store_path(spark, "oof", "a") == store_path(spark, "oof", "a") != store_path(spark, "oof", "b")
