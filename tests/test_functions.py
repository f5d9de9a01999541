import math
import random

import pytest
from pyspark.sql import functions as F

from ratelens.functions import calibration as cal
from ratelens.functions import text as tx
from ratelens.functions.ordinal import qwk
from ratelens.operators import models, splitting
from ratelens.plans.fixtures import SLANG


def matrix_kappa(ys, ps):
    n = len(ys)
    o = [[sum(1 for y, p in zip(ys, ps) if (y, p) == (i, j)) for j in range(1, 6)] for i in range(1, 6)]
    rows, cols = [sum(r) for r in o], [sum(c) for c in zip(*o)]
    w = [[(i - j) ** 2 / 16 for j in range(5)] for i in range(5)]
    chance = sum(w[i][j] * rows[i] * cols[j] / n for i in range(5) for j in range(5))
    return 1 - sum(w[i][j] * o[i][j] for i in range(5) for j in range(5)) / chance


def test_kappa_of_sums_equals_that_of_the_matrix(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, p int")
    got, shifted = df.agg(qwk(F.col("y"), F.col("p")), qwk(F.col("y") - 1, F.col("p") - 1)).first()
    want = matrix_kappa(*zip(*rows))
    assert math.isclose(got, want, rel_tol=1e-12) and math.isclose(shifted, want, rel_tol=1e-12)


def test_kappa_is_null_without_variation(spark):
    assert spark.createDataFrame([(3, 3), (3, 3)], "y int, p int").agg(qwk(F.col("y"), F.col("p"))).first()[0] is None


def test_uniform_probabilities_and_perfect_calibration(spark):
    df = spark.createDataFrame([([0.2] * 5,)], "p array<double>")
    assert df.select(cal.derived_cumulative(F.col("p"))).first()[0] == pytest.approx([0.8, 0.6, 0.4, 0.2])
    sure = spark.createDataFrame([(1.0, 1), (0.0, 0), (1.0, 1)], "p double, e int")
    assert cal.ece(sure, "p", "e").first()["ece"] == 0


def test_planted_violation_and_chain_gap(spark):
    df = spark.createDataFrame([([0.9, 0.5, 0.4, 0.1],), ([0.5, 0.6, 0.2, 0.1],)], "q array<double>")
    row = cal.monotonicity(df, "q").first()
    assert (row.n_rows, row.n_violating) == (2, 1) and row.largest_rise == pytest.approx(0.1)
    z = spark.createDataFrame([([2.0, 1.0, 0.5, -1.0],)], "z array<double>").withColumn("q", cal.chain(F.col("z")))
    z = z.withColumn("p", cal.chain_probs(F.col("q")))
    assert cal.chain_gap(z, "q", "p").first().gap_max < 1e-6
    assert sum(z.first().p) == pytest.approx(1) and z.select(cal.rank_decode(F.col("q"))).first()[0] == 2


@pytest.mark.parametrize(
    "raw,want",
    [
        ("gpp, mantap", "tidak apa-apa, mantap"),
        ("\U0001f996 mantap", "mantap"),
        ("SENAAAANG!!! 😊", "senaang! senang"),
        ("lihat https://x.y/z @Budi_1 ya", "lihat ya"),
        ("❤️ ok", "suka ok"),
        (None, ""),
        (" \n ", ""),
        ("a-bgt bgt.", "a-bgt banget."),
    ],
)
def test_cleaning(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(tx.clean(F.col("t"), SLANG)).first()[0] == want


def test_cleaning_without_a_lexicon_keeps_tokens(spark):
    assert spark.createDataFrame([("gpp",)], "t string").select(tx.clean(F.col("t"), {})).first()[0] == "gpp"


def test_sample_sizes():
    assert splitting.cochran_n(2856)["n"] == 93 and splitting.cochran_n(2856)["n0"] == pytest.approx(96.04)
    assert splitting.cochran_n(10**6)["n"] == 97 and splitting.cochran_n(0)["n"] == 0
    assert splitting.allocation({1: 3000, 2: 1000, 3: 300, 4: 100}) == {2: 15, 3: 15, 4: 15, 1: 55}
    assert splitting.allocation({1: 3000, 2: 1000, 3: 300, 4: 7}) == {2: 15, 3: 15, 4: 7, 1: 63}
    assert splitting.subset_size(100, 0.3) == 30 and splitting.subset_size(5, 0.1) == 1


def test_temperature_of_right_logits_is_one(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(800):
        z = [rng.gauss(0, 1.5) for _ in range(5)]
        e = [math.exp(v) for v in z]
        rows.append((z, rng.choices(range(5), e)[0]))
    grid = models.temperature_grid(spark.createDataFrame(rows, "logits array<double>, label0 int"), (0.25, 0.5, 1.0, 2.0, 4.0))
    assert models.best_temperature(grid).first()[0] == 1.0
    assert models.best_temperature(grid.where("false")).first()[0] == 1.0
