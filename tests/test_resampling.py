"""Draws counted where they are made, against the hash library and rows drawn one by one."""

import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.functions.rng import h
from ratelens.operators import resampling, significance
from ratelens.operators.resampling import ErrorGap, Kappa, md5_words, positions, resampled_sums
from ratelens.plans import q_statistics
from ratelens.plans.config import SPLIT_SEEDS


@pytest.mark.parametrize(("first", "count"), [(0, 10), (10, 90), (99_990, 10), (1_234_567, 50)])
def test_digests_are_those_of_the_library(first, count):
    found = md5_words(b"42|1999|", first, count)
    for i in range(count):
        assert found[:, i].astype("<u4").tobytes() == hashlib.md5(b"42|1999|%d" % (first + i)).digest()


def drawn(seed, rep, n):
    digests = [hashlib.md5(b"%d|%d|%d" % (seed, rep, b)).hexdigest() for b in range(-(-n // 4))]
    return [int(int(d[8 * k : 8 * k + 8], 16) / 2**32 * n) for d in digests for k in range(4)][:n]


@pytest.mark.parametrize("n", [1, 4, 41, 70_003])
def test_positions_of_a_draw(n):
    assert np.concatenate(list(positions(42, 7, n))).tolist() == drawn(42, 7, n)


@pytest.mark.parametrize("chunk", [160_000_000, 400])
def test_sums_against_rows_drawn_one_by_one(spark, monkeypatch, chunk):
    """Missing labels, two words of labels, and (with the small limit) draws over several chunks."""
    monkeypatch.setattr(resampling, "CHUNK_BYTES", chunk)
    n, names = 300, ["y", *(f"p{i}" for i in range(22))]
    labels = [F.when(h(c, F.col("id")) % 11 != 0, (h(c, F.col("id")) % 5 + 1).cast("int")).alias(c) for c in names]
    wide = spark.range(n).select(F.col("id").alias("review_id"), *labels)
    rows = wide.withColumn("bucket", h("bucket", F.col("review_id")) % resampling.BUCKETS).orderBy("bucket", "review_id").collect()
    kappa, gap = Kappa("k", "y", "p21"), ErrorGap("g", "y", ("p0", "p1"), ("p2",))
    found = {r["rep"]: r for r in resampled_sums(wide, 3, names, [kappa, gap]).collect()}
    assert sorted(found) == [-1, 0, 1, 2]
    for rep, r in found.items():
        own = [rows[i] for i in (range(n) if rep < 0 else drawn(42, rep, n))]
        both = [(x["y"], x["p21"]) for x in own if x["y"] and x["p21"]]
        assert [r[c] for c in kappa.sums] == [len(both), *(sum(f(y, p) for y, p in both) for f in (lambda y, p: (y - p) ** 2, lambda y, p: y * y, lambda y, p: p * p, lambda y, p: y, lambda y, p: p))]
        full = [x for x in own if all(x[c] for c in ("y", "p0", "p1", "p2"))]
        assert [r[c] for c in gap.sums] == [len(full), sum(abs(x["p0"] - x["y"]) + abs(x["p1"] - x["y"]) - 2 * abs(x["p2"] - x["y"]) for x in full)]


def test_no_rows_and_labels_that_do_not_fit(spark):
    wide = spark.createDataFrame([], "review_id long, y int, p int")
    assert resampled_sums(wide, 2, ["y", "p"], [Kappa("k", "y", "p")]).isEmpty()
    with pytest.raises(Exception, match="labels beyond 1 to 7"):
        resampled_sums(spark.createDataFrame([(1, 3, 9)], wide.schema), 2, ["y", "p"], [Kappa("k", "y", "p")]).collect()


def test_a_draw_is_counted_piece_by_piece():
    n = 1_000_000
    tracemalloc.start()
    found = resampling._counts(3, n, 0, n, 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.sum() == n and peak < 12 * n  # four bytes a row and a piece; all positions and their counts are 24 and more
    part = resampling._counts(3, n, 1000, 5000, 42)
    assert (part == found[1000:6000]).all()


def test_wide_predictions_travel_as_words_of_bits(spark):
    """Missing, repeated and null predictions; what is shuffled is a few words a review."""
    rows = [("M1_Baseline_CE", 42, 1, 3, 2), ("M1_Baseline_CE", 42, 1, 3, 4), ("M6_CleanedSevere_CORN", 2024, 1, 3, 5), ("M4_Baseline_CORN", 123, 1, 3, None), ("other", 42, 2, None, 1), ("M3_CleanedSevere_CE", 123, 3, 9, 1)]
    long = spark.createDataFrame(rows, "scenario string, weight_seed int, review_id long, y_true int, y_pred int")
    wide = significance.wide_predictions(long)
    found = {r["review_id"]: {k: v for k, v in r.asDict().items() if v is not None and k[0] in "yp"} for r in wide.collect()}
    assert found == {1: {"y": 3, "p_M1_42": 4, "p_M6_2024": 5}, 2: {}, 3: {"y": 9, "p_M3_123": 1}}
    assert [f.dataType.simpleString() for f in wide.schema][:20] == ["bigint", *["int"] * 19]
    assert len(set(re.findall(r"partial_\w+\([^)]*", wide._jdf.queryExecution().sparkPlan().toString()))) <= 3
    with pytest.raises(Exception, match="labels beyond 1 to 5"):
        significance.wide_predictions(spark.createDataFrame([("M1_Baseline_CE", 42, 1, 3, 6)], long.schema)).collect()


def test_two_splits_leave_the_third_alone(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(q_statistics, "by_split", lambda spark, path, schema, f, splits=SPLIT_SEEDS: made.extend(splits) or spark.createDataFrame([], schema))
    assert q_statistics.R.queries["consistency_two_splits"](spark, sf).isEmpty()
    assert made == list(SPLIT_SEEDS[:2])


def test_digests_are_made_once_for_all_tables(monkeypatch):
    made = []
    monkeypatch.setattr(resampling, "md5_words", lambda prefix, first, count: made.append(count) or md5_words(prefix, first, count))
    pieces = [(9_001, 0, 9_001), (8_000, 100, 3_000), (1, 0, 1)]
    found = resampling._shared_counts(3, pieces, 42)
    assert sum(made) == -(-9_001 // 4)
    for own, (n, start, rows) in zip(found, pieces, strict=True):
        assert own.tolist() == np.bincount(drawn(42, 3, n), minlength=n)[start : start + rows].tolist()


@pytest.mark.parametrize("chunk", [160_000_000, 400])
def test_several_tables_at_once_are_each_as_alone(spark, monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", chunk)
    label = lambda c: (h(c, F.col("id")) % 5 + 1).cast("int").alias(c)
    rows = spark.range(150).select(F.col("id").alias("review_id"), label("y"), label("p"), F.explode(F.array(F.lit(42), F.lit(7))).alias("s")).where((F.col("s") == 42) | (F.col("review_id") % 3 == 0))
    kappa = Kappa("k", "y", "p")
    both = resampled_sums(rows, 3, ["y", "p"], [kappa], by="s")
    for s in (42, 7):
        alone = resampled_sums(rows.where(F.col("s") == s), 3, ["y", "p"], [kappa])
        assert sorted(map(tuple, both.where(F.col("s") == s).select(*alone.columns).collect())) == sorted(map(tuple, alone.collect()))


def test_reviews_are_dealt_to_buckets_once(spark, sf):
    """A bootstrap's only shuffle of rows is that of the reviews, before each of them has its predictions; the rows are the same."""
    dealt, wide = q_statistics.dealt(spark, sf), q_statistics.wide(spark, sf)
    assert sorted(map(str, dealt.drop("draw_bucket").collect())) == sorted(map(str, wide.collect()))
    columns = ["y", *(c for c in wide.columns if c.startswith("e_"))]
    packed = resampling.packed_buckets(dealt, columns, 5)
    assert len(re.findall(r"\bExchange\b", packed._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted(map(str, packed.collect())) == sorted(map(str, resampling.packed_buckets(wide, columns, 5).collect()))
