"""Multinomial draws over cells: exact points, the distribution of row draws, cost by cells, the suite's tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.operators import cells, significance
from ratelens.plans.config import HYPOTHESES, SCENARIOS, WEIGHT_SEEDS

SCHEMA = "scenario string, weight_seed int, review_id long, y_true int, y_pred int"


def predictions(spark, n, seed=1, same=False):
    r = np.random.default_rng(seed)
    y = r.integers(1, 6, n)
    rows = []
    for i, s in enumerate(SCENARIOS):
        for w in WEIGHT_SEEDS:
            p = np.clip(y + (0 if same else 1) * r.integers(-1 - i % 3, 2 + i % 2, n), 1, 5)
            rows += [(s["name"], w, int(j), int(y[j]), int(p[j])) for j in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def wide(spark):
    return significance.wide_predictions(predictions(spark, 300)).cache()


def _qwk(y, p):
    y, p = y.astype(float), p.astype(float)
    return 1 - ((y - p) ** 2).sum() / ((y * y).sum() + (p * p).sum() - 2 * y.sum() * p.sum() / len(y))


def _direct(pdf, a, b):
    """The three metrics and the differences by seed, from rows."""
    y = pdf.y.to_numpy()
    p = {s: [pdf[significance.unit(s, w)].to_numpy() for w in WEIGHT_SEEDS] for s in (a, b)}
    err = {s: np.mean([np.abs(x - y) for x in p[s]], axis=0) for s in p}
    ens = {s: np.clip(np.rint(np.mean(p[s], axis=0)), 1, 5) for s in p}
    per = [_qwk(y, u) - _qwk(y, v) for u, v in zip(p[a], p[b])]
    return (err[a] - err[b]).mean(), _qwk(y, ens[a]) - _qwk(y, ens[b]), float(np.mean(per)), per


def test_points_are_those_of_the_rows(spark, wide):
    pdf = wide.toPandas()
    drawn = {(r.hypothesis, r.metric): r for r in cells.cell_effects(wide, 20).collect()}
    points = {(r.hypothesis, r.metric): r for r in cells.effect_points(wide).collect()}
    assert len(drawn) == len(points) == 15
    for name, a, b in HYPOTHESES:
        *three, per = _direct(pdf, a, b)
        for m, want in zip(cells.METRICS, three):
            assert abs(drawn[name, m].diff - want) < 1e-8 and abs(points[name, m].diff - want) < 1e-8
            assert drawn[name, m].ci_low <= drawn[name, m].ci_high
        for w, d in zip(WEIGHT_SEEDS, per):
            assert abs(points[name, "QWK_per_seed"][f"diff_{w}"] - d) < 1e-8 and abs(drawn[name, "QWK_per_seed"][f"diff_{w}"] - d) < 1e-8
            assert points[name, "MAE"][f"diff_{w}"] is None


def test_draws_are_distributed_like_row_draws(spark, wide):
    """Two-sample Kolmogorov-Smirnov distance of each statistic against resampled rows, and the means and deviations."""
    pdf, reps = wide.toPandas(), 1500
    name, a, b = HYPOTHESES[0]
    drawn = cells.resampled(cells.hypothesis_cells(wide).where(F.col("hypothesis") == name), "hypothesis", ("y", "a", "b"), cells.effect_stats(), cells.METRICS, reps).where("rep >= 0").toPandas()
    assert sorted(drawn.rep) == list(range(reps))
    rng = np.random.default_rng(8)
    rows = np.array([_direct(pdf.iloc[rng.integers(0, len(pdf), len(pdf))], a, b)[:3] for _ in range(reps)])
    for i, m in enumerate(cells.METRICS):
        x, z = np.sort(drawn[m].to_numpy()), np.sort(rows[:, i])
        grid = np.concatenate([x, z])
        distance = np.abs(np.searchsorted(x, grid, "right") - np.searchsorted(z, grid, "right")).max() / reps
        assert distance < 1.95 * np.sqrt(2 / reps)  # passed by chance once in a thousand
        assert abs(x.std() / z.std() - 1) < 0.1 and abs(x.mean() - z.mean()) < 4 * z.std() / np.sqrt(reps)


def test_identical_predictions_give_zero(spark):
    same = significance.wide_predictions(predictions(spark, 40, same=True))
    assert {(r.diff, r.ci_low, r.ci_high) for r in cells.cell_effects(same, 60).collect()} == {(0.0, 0.0, 0.0)}


def test_cells_do_not_grow_with_rows(spark, wide):
    one = cells.hypothesis_cells(wide)
    many = cells.hypothesis_cells(wide.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))))
    assert one.count() == many.count()
    assert one.agg(F.sum("n")).first()[0] * 50 == many.agg(F.sum("n")).first()[0]
    a, b = (cells.resampled(c, "hypothesis", ("y", "a", "b"), cells.effect_stats(), cells.METRICS, 100).where("rep >= 0").groupBy("hypothesis").agg(F.stddev("MAE").alias("s")).collect() for c in (one, many))
    ratio = np.mean([x.s / y.s for x, y in zip(sorted(a), sorted(b))])
    assert 5 < ratio < 10  # fifty times the rows: deviations shrink by their root


def test_repeated_runs_agree_and_wide_scales_are_refused(spark, wide, monkeypatch):
    take = lambda df: sorted(map(tuple, df.collect()))
    assert take(cells.cell_effects(wide, 70)) == take(cells.cell_effects(wide.repartition(5), 70))
    assert cells.cell_effects(wide.limit(0), 10).count() == 0
    monkeypatch.setattr(cells, "MOST_CELLS", 10)
    with pytest.raises(ValueError):
        cells.cell_effects(wide, 10)


def test_suite_writes_six_tables_once(spark, tmp_path):
    long = predictions(spark, 60)
    first = cells.significance_suite(long, f"file://{tmp_path}/s", 40, 42)
    assert set(first) == set(cells.SUITE) and set(first.values()) == {"written"}
    assert set(cells.significance_suite(long, f"file://{tmp_path}/s", 40, 42).values()) == {"already there, identical"}
    counts = {t: spark.read.parquet(f"file://{tmp_path}/s/{t}").count() for t in cells.SUITE}
    assert counts == {"final_results": 6, "significance": 5, "effects_mae": 5, "effects_qwk_ensemble": 5, "effects_qwk_per_seed": 5, "effects_long": 15}
    row = spark.read.parquet(f"file://{tmp_path}/s/effects_long")
    assert row.where("metric <> 'MAE' and p is not null").count() == 0 and row.where("metric = 'MAE' and p is null").count() == 0
    with pytest.raises(FileExistsError):
        cells.significance_suite(predictions(spark, 60, seed=2), f"file://{tmp_path}/s", 40, 42)
