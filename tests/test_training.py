"""Scenario training against a plain loop, resumption, patience, selection, checkpoints, and the tables that follow."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.operators import cells, significance, training
from ratelens.operators.oof_store import LineageError
from ratelens.operators.training import Recipe, State, Trainer
from ratelens.plans.config import SCENARIOS, scenario_by_name

CE, CORN = "M1_Baseline_CE", "M6_CleanedSevere_CORN"
SHORT = Recipe(epochs=3, batch=8)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    out = []
    for i in range(240):
        y = int(r.integers(1, 6))
        part = "train" if i % 10 < 6 else "val" if i % 10 < 8 else "test"
        noise = bool(r.random() < 0.2) if part == "train" else None
        out.append((i, y, [float(y + r.normal(0, 0.7)), float(r.normal())], part, noise, (noise and r.random() < 0.5) if part == "train" else None))
    return spark.createDataFrame(out, "review_id long, rating int, embedding array<double>, part string, is_noise boolean, is_noise_severe boolean").cache()


def plain(rows, scenario, seed, recipe):
    """The weights after every epoch by scalar loops: one shard, mini-batches, warm-up, decoupled decay."""
    known = scenario_by_name(scenario)
    own = [r for r in sorted(rows, key=lambda r: r.review_id) if r.part == "train"]
    own = [r for r in own if not (known["variant"] == "hard" and r.is_noise) and not (known["variant"] == "severe" and r.is_noise_severe)]
    k = 5 if known["loss"] == "ce" else 4
    w = [[float(x) for x in line] for line in training.fresh(known["loss"], seed, 2).w]
    m, v = [[0.0] * 3 for _ in range(k)], [[0.0] * 3 for _ in range(k)]
    per, t, out = math.ceil(len(own) / recipe.batch), 0, []
    total = per * recipe.epochs
    warm = max(1, round(total * recipe.warm_up))
    for epoch in range(1, recipe.epochs + 1):
        order = np.random.default_rng([seed, 0, epoch]).permutation(len(own))
        for i in range(per):
            t += 1
            batch = [own[j] for j in order[i * recipe.batch : (i + 1) * recipe.batch]]
            g, n = [[0.0] * 3 for _ in range(k)], 0
            for r in batch:
                x, y = [*r.embedding, 1.0], r.rating - 1
                z = [sum(a * b for a, b in zip(line, x)) for line in w]
                if k == 5:
                    e = [math.exp(a - max(z)) for a in z]
                    d = [a / sum(e) - (c == y) for c, a in enumerate(e)]
                    n += 1
                else:
                    d = [1 / (1 + math.exp(-z[c])) - (y > c) if y >= c else 0.0 for c in range(4)]
                    n += sum(y >= c for c in range(4))
                for c in range(k):
                    for f in range(3):
                        g[c][f] += d[c] * x[f]
            rate = recipe.rate * (t / warm if t <= warm else (total - t) / max(1, total - warm))
            for c in range(k):
                for f in range(3):
                    a = g[c][f] / n
                    m[c][f] = 0.9 * m[c][f] + 0.1 * a
                    v[c][f] = 0.999 * v[c][f] + 0.001 * a * a
                    w[c][f] -= rate * (recipe.decay * w[c][f] + m[c][f] / (1 - 0.9**t) / (math.sqrt(v[c][f] / (1 - 0.999**t)) + 1e-8))
        out.append(np.array(w))
    return out


def checkpoints(trainer, spark):
    return {(r.scenario, r.weight_seed, r.epoch): np.array(r.heads) for r in trainer.log(spark).collect()}


def test_epochs_are_those_of_a_plain_loop(spark, rows, tmp_path):
    trainer = Trainer(f"file://{tmp_path}/t", 42, SHORT, (CE, CORN), (42, 123))
    predicted = trainer.run(rows)
    found, data = checkpoints(trainer, spark), rows.collect()
    assert len(found) == 12
    for scenario in (CE, CORN):
        for seed in (42, 123):
            for epoch, w in enumerate(plain(data, scenario, seed, SHORT), 1):
                assert np.allclose(found[scenario, seed, epoch], w.ravel(), rtol=1e-8, atol=1e-10)
    # errors and kappas of the log, and the predictions of the chosen epoch, straight from the weights
    val, test = [r for r in data if r.part == "val"], {r.review_id: r for r in data if r.part == "test"}
    for r in trainer.log(spark).collect():
        loss = scenario_by_name(r.scenario)["loss"]
        w = np.array(r.heads).reshape(training.outputs(loss), 3)
        p = training.decode(w, np.array([[*x.embedding, 1.0] for x in val]), loss)
        assert abs(r.mae - np.abs(p - np.array([x.rating for x in val])).mean()) < 1e-12
    best = {(r.scenario, r.weight_seed): r.epoch for r in significance.best_epoch(trainer.log(spark), training.UNIT).collect()}
    got = predicted.collect()
    assert len(got) == 4 * len(test)
    for r in got:
        loss = scenario_by_name(r.scenario)["loss"]
        w = found[r.scenario, r.weight_seed, best[r.scenario, r.weight_seed]].reshape(training.outputs(loss), 3)
        x = test[r.review_id]
        assert r.y_true == x.rating and r.y_pred == training.decode(w, np.array([[*x.embedding, 1.0]]), loss)[0]


def test_interrupted_training_ends_as_an_unbroken_one(spark, rows, tmp_path, monkeypatch):
    whole = Trainer(f"file://{tmp_path}/whole", 42, SHORT, (CE,), (42, 123))
    want = sorted(map(tuple, whole.run(rows).collect()))
    broken = Trainer(f"file://{tmp_path}/broken", 42, SHORT, (CE,), (42, 123))
    real, calls = training._epoch, []

    def dies(train, states, epoch, recipe):
        calls.append(epoch)
        if epoch == 3:
            raise RuntimeError("lost")
        return real(train, states, epoch, recipe)

    monkeypatch.setattr(training, "_epoch", dies)
    with pytest.raises(RuntimeError):
        broken.run(rows)
    monkeypatch.setattr(training, "_epoch", lambda *a: (calls.append(a[2]), real(*a))[1])
    assert sorted(map(tuple, broken.run(rows).collect())) == want
    assert calls == [1, 2, 3, 3]
    a, b = checkpoints(whole, spark), checkpoints(broken, spark)
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)
    # a second run trains nothing, a further unit is trained alone and leaves the others as they are
    assert sorted(map(tuple, broken.run(rows).collect())) == want and calls == [1, 2, 3, 3]
    more = dataclasses.replace(broken, seeds=(42, 123, 2024))
    assert more.run(rows).select("weight_seed").distinct().count() == 3
    assert {k: v.tolist() for k, v in checkpoints(more, spark).items() if k[1] != 2024} == {k: v.tolist() for k, v in b.items()}


def test_patience_stops_as_the_operator_says(spark, rows, tmp_path):
    trainer = Trainer(f"file://{tmp_path}/t", 42, Recipe(epochs=8, rate=0.3, patience=2), (CE, "M4_Baseline_CORN"), (42, 123))
    trainer.run(rows)
    log = trainer.log(spark)
    last = {(r.scenario, r.weight_seed): r.e for r in log.groupBy(*training.UNIT).agg(F.max("epoch").alias("e")).collect()}
    assert {(r.scenario, r.weight_seed): r.last_epoch for r in significance.early_stop(log, 2, training.UNIT).collect()} == last
    assert min(last.values()) < 8
    assert log.where("stopped").count() == 4


def test_shards_are_averaged_by_their_rows(spark, rows):
    recipe = Recipe(epochs=2, batch=8)
    train = rows.where("part = 'train'").withColumn("shard", (F.col("review_id") % 3 == 0).cast("int"))
    state = training.fresh("ce", 42, 2)
    after, facts = training._epoch(train, {(CE, 42): state}, 1, recipe)
    total, n = np.zeros_like(state.w), 0
    for shard in (0, 1):
        own = sorted((r for r in train.collect() if r.shard == shard), key=lambda r: r.review_id)
        s, _ = training.train_shard(state, np.array([[*r.embedding, 1.0] for r in own]), np.array([r.rating - 1 for r in own]), "ce", 42, shard, 1, recipe)
        total, n = total + len(own) * s.w, n + len(own)
    assert np.allclose(after[CE, 42].w, total / n, atol=1e-12) and facts[CE, 42][0] == n


def test_learns_and_feeds_the_tables(spark, rows, tmp_path):
    trainer = Trainer(f"file://{tmp_path}/t", 42, Recipe(epochs=6, rate=0.05))
    long = trainer.run(rows)
    table = significance.results_table(long).collect()
    assert len(table) == 6 and all(r.n_seeds == 3 and r.mae_mean < 0.9 for r in table)
    assert cells.cell_effects(significance.wide_predictions(long), 30).count() == 15


def test_wrong_rows_and_spoiled_checkpoints_are_refused(spark, rows, tmp_path):
    trainer = Trainer(f"file://{tmp_path}/t", 42, SHORT, (CE,), (42,))
    trainer.run(rows)
    other = dataclasses.replace(trainer, seeds=(42, 123))
    with pytest.raises(LineageError):
        Trainer(trainer.path, 42, SHORT, (CE,), (42, 123)).load([r.asDict() | {"heads": [0.0] * 15} for r in trainer.log(spark).collect()], 2)
    state = trainer.load(trainer.log(spark).where("epoch = 3").collect(), 2)[CE, 42]
    assert state.sha256 == trainer.log(spark).where("epoch = 3").first()["sha256"]
    assert isinstance(state, State) and other.todo(spark) == [(CE, 123)]
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/t/predictions"), True)
    with pytest.raises(LineageError):
        trainer.run(rows.where("review_id > 3"))
    assert Trainer(f"file://{tmp_path}/none", 42, SHORT).run(rows.limit(0)).count() == 0


def test_gradients_match_differences():
    r = np.random.default_rng(4)
    x, y = np.hstack([r.normal(size=(30, 3)), np.ones((30, 1))]), r.integers(0, 5, 30)
    for loss in ("ce", "corn"):
        w = r.normal(size=(training.outputs(loss), 4))
        g = training.gradient(w, x, y, loss)[1]
        for at in [(0, 0), (2, 3), (3, 1)]:
            d = np.zeros_like(w)
            d[at] = 1e-6
            assert abs((training.gradient(w + d, x, y, loss)[0] - training.gradient(w - d, x, y, loss)[0]) / 2e-6 - g[at]) < 1e-6
    assert {s["loss"] for s in SCENARIOS} == {"ce", "corn"}
