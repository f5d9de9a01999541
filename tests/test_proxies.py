"""Model stage against brute force: heads, calibration, temperatures, flags by fold count, paired intervals."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.operators import confident, models, proxies, regression
from ratelens.operators.regression import Head, fit_heads
from ratelens.operators.splitting import stratified_kfold


@pytest.fixture(scope="module")
def points(spark):
    """Sixty rows in five ordered classes along one axis, with noise."""
    r = np.random.default_rng(3)
    rows = [(i, i % 5 + 1, [float(i % 5 + r.normal()), float(r.normal()), float(r.normal())]) for i in range(60)]
    return spark.createDataFrame(rows, "review_id long, rating int, embedding array<double>")


def _sums(x, y, w):
    z = x @ w.T
    if len(w) == 1:
        p = 1 / (1 + np.exp(-z[:, 0]))
        return (p - y)[None] @ x
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    return p.T @ x


def test_heads_are_where_the_penalised_loss_is_flat(spark, points):
    rows = stratified_kfold(points, 3, 42, deal="d").select(F.col("embedding").alias("x"), "fold", (F.col("d") % 3).alias("part"), (F.col("rating") - 1).alias("label0"))
    heads = [Head(0, 1), Head(2, 0), Head(1, 2, 0), Head(1, 2, 3)]
    data = rows.toPandas()
    for head, fitted in zip(heads, fit_heads(rows, heads, 5)):
        own = data[(data.fold != head.fold) & (data.part != head.part)]
        y = own.label0.to_numpy()
        if head.threshold is not None:
            own = own[own.label0 >= head.threshold]
            y = (own.label0 > head.threshold).astype(int).to_numpy()
        x = np.hstack([np.stack(own.x), np.ones((len(own), 1))])
        w = np.array([[*a, b] for a, b in fitted])
        grad = _sums(x, y, w) + w * np.array([1, 1, 1, 0])
        assert np.abs(grad).max() < 1e-5 * len(own)


def test_heads_without_rows(spark, points):
    rows = points.where("rating = 1").select(F.col("embedding").alias("x"), F.lit(0).alias("fold"), F.lit(0).alias("part"), F.lit(0).alias("label0"))
    (low,), multi = fit_heads(rows, [Head(0, 1, 0), Head(0, 1)], 5)
    assert low == ([0.0] * 3, -50.0) and len(multi) == 5
    assert fit_heads(rows.limit(0), [Head(0, 1)], 5) == [[]]


def test_platt_is_where_the_loss_is_flat(spark):
    r = np.random.default_rng(5)
    rows = [(g, float(s), bool(r.random() < 1 / (1 + np.exp(-(2 * s - g))))) for g in range(2) for s in r.normal(size=80)]
    found = models.platt(spark.createDataFrame(rows, "g int, score double, hit boolean"), ("g",))
    assert len(found) == 2
    for g, a, b in found:
        s, hit = np.array([x[1] for x in rows if x[0] == g]), np.array([x[2] for x in rows if x[0] == g])
        t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
        d = 1 / (1 + np.exp(-(a * s + b))) - t
        assert abs((d * s).sum()) < 1e-4 and abs(d.sum()) < 1e-4


@pytest.mark.parametrize("ordinal", [False, True])
def test_temperature_against_a_dense_grid(spark, ordinal):
    r = np.random.default_rng(7)
    rows = [(0, [float(v) for v in r.normal(size=4 if ordinal else 5) * 3], int(r.integers(5))) for _ in range(40)]
    df = spark.createDataFrame(rows, "outer int, logits array<double>, label0 int")
    z, y = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])

    def nll(t):
        if ordinal:
            q = np.cumprod(1 / (1 + np.exp(-z / t)), axis=1)
            p = np.maximum(np.hstack([np.ones((40, 1)), q]) - np.hstack([q, np.zeros((40, 1))]), 1e-8)
        else:
            p = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return -np.log(np.maximum(p[np.arange(40), y], 1e-8)).mean()

    t = models.fit_temperatures(df, "outer", ordinal)[0]
    assert nll(t) <= min(nll(c) for c in np.geomspace(0.01, 100, 4000)) + 1e-6


def test_probabilities_and_shapes(spark, points):
    labelled = points.withColumn("label", F.col("rating") - 1)
    for i in models.PROXIES:
        oof, temperatures = models.proxy_oof(labelled if i != 1 else labelled.withColumn("embedding", F.concat("embedding", F.slice("embedding", 1, 1))), i)
        rows = oof.collect()
        assert len({r.review_id for r in rows}) == len(rows) == 60
        assert all(len(r.probs) == 5 and abs(sum(r.probs) - 1) < 1e-9 for r in rows)
        assert len(temperatures) == (5 if i >= 2 else 0)
    assert np.mean([abs(r.label - int(np.argmax(r.probs))) <= 1 for r in rows]) > 0.75
    with pytest.raises(ValueError):
        models.proxy_oof(labelled, 0, 3)
    assert models.proxy_oof(labelled.limit(0), 3)[0].count() == 0


def _kappa(y, p):
    y, p = y.astype(float), p.astype(float)
    return 1 - ((y - p) ** 2).sum() / ((y * y).sum() + (p * p).sum() - 2 * y.sum() * p.sum() / len(y))


def test_fold_counts_against_direct_computation(spark, points):
    oof = {k: df.cache() for k, df in proxies.predictions_by_k(points).items()}
    table = {r.k: r for r in proxies.k_table(oof).collect()}
    noise = {k: {r.review_id for r in confident.detect(df).where("is_noise").collect()} for k, df in oof.items()}
    pred = {k: {r.review_id: int(np.argmax(r.probs)) + 1 for r in df.collect()} for k, df in oof.items()}
    truth = {r.review_id: r.rating for r in points.collect()}
    assert sorted(table) == [3, 5, 10]
    for k, row in table.items():
        either = noise[k] | noise[5]
        assert row.n_flagged == len(noise[k])
        assert row.jaccard_vs_base == (round(len(noise[k] & noise[5]) / len(either), 9) if either else None)
    h = lambda i: int(hashlib.md5(f"bucket|{i}".encode()).hexdigest()[:8], 16) % 64
    order = sorted(truth, key=lambda i: (h(i), i))
    y = np.array([truth[i] for i in order])
    p = {k: np.array([pred[k][i] for i in order]) for k in oof}
    draws = []
    for rep in range(30):
        hexes = "".join(hashlib.md5(f"42|{rep}|{block}".encode()).hexdigest() for block in range(15))
        draws.append([int(int(hexes[8 * j : 8 * j + 8], 16) / 2**32 * 60) for j in range(60)])
    pairs = proxies.paired_qwk(oof, 30).collect()
    assert sorted((r.k_x, r.k_y) for r in pairs) == [(3, 5), (3, 10), (5, 10)]
    for r in pairs:
        boot = [_kappa(y[d], p[r.k_x][d]) - _kappa(y[d], p[r.k_y][d]) for d in map(np.array, draws)]
        lo, hi = np.percentile(boot, [2.5, 97.5])
        assert abs(r.qwk_diff - (_kappa(y, p[r.k_x]) - _kappa(y, p[r.k_y]))) < 1e-8
        assert abs(r.ci_low - lo) < 1e-8 and abs(r.ci_high - hi) < 1e-8 and r.covers_zero == (lo <= 0 <= hi)


def test_heads_with_tasks_that_have_no_rows(spark, monkeypatch):
    """Larger tables are fitted by several tasks, of which some may be empty."""
    monkeypatch.setattr(regression, "TASK_ROWS", 1)
    rows = [([float(i % 7), float(i % 3)], 0, 0, i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "x array<double>, fold int, part int, label0 int")
    spread = df.repartitionByRange(12, "label0").cache()  # two labels: most of the parts are empty
    assert spread.rdd.getNumPartitions() > 2
    (one,), (other,) = (regression.fit_heads(d, [regression.Head(1, 1)], 2) for d in (df.coalesce(1), spread))
    for (w, b), (v, c) in zip(one, other, strict=True):
        assert [*w, b] == pytest.approx([*v, c], abs=1e-6)
