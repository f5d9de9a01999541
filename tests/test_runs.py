"""Sub-word tokens, JSON, annotators' joins, gates that fail, tables by split, tails of the normal distribution."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.functions import tokens
from ratelens.operators import agreement, checks, preprocess, significance
from ratelens.plans import q_runs
from ratelens.sources.store import by_split, read_partitions
from ratelens.sources.tables import json_column, read_json_objects, table


def test_token_counts_and_arrays_are_the_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q_runs.vocabulary())
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "  \n")], "doc_id long, text string"))
    want = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    rows = docs.select("doc_id", tokens.subword_count(F.col("text"), q_runs.vocabulary(), 2).alias("n"), tokens.padded_tokens(F.col("text"), q_runs.vocabulary(), 40, pad=7).alias("t")).collect()
    for r in rows:
        ids = want[r.doc_id]
        assert r.n == len(ids) + 2
        assert r.t.ids == ids[:40] + [7] * (40 - len(ids[:40])) and r.t.mask == [1] * len(ids[:40]) + [0] * (40 - len(ids[:40]))
    summary = preprocess.truncation(docs, tokens.subword_count(F.col("text"), q_runs.vocabulary(), 2)).first()
    lengths = sorted(len(v) + 2 for v in want.values())
    assert summary.pct_truncated == round(100 * sum(n > 128 for n in lengths) / len(lengths), 6)
    middle = (lengths[(len(lengths) - 1) // 2] + lengths[len(lengths) // 2]) / 2
    assert summary.median_len == int(middle)


def test_masked_means(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[5.0, 5.0]], [0])]
    df = spark.createDataFrame(rows, "i int, v array<array<double>>, m array<int>")
    assert {r.i: r.p for r in df.select("i", tokens.masked_mean(F.col("v"), F.col("m")).alias("p")).collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_json_by_schema(spark, tmp_path):
    rows = [(1, '{"k": 3, "extra": 1}'), (2, '{"k": "x"}'), (3, '{"k": 4'), (4, None), (5, "{}"), (6, "[]"), (7, "")]
    got = {r.i: (r.json and r.json.k, r.malformed) for r in json_column(spark.createDataFrame(rows, "i int, j string"), "j", "k bigint").collect()}
    assert got[1] == (3, False) and got[2] == (None, True) and got[3] == (None, True) and got[4] == (None, False) and got[5] == (None, False)
    (tmp_path / "a.json").write_text(json.dumps({"n": 2, "name": "x"}, indent=1))
    (tmp_path / "b.json").write_text('{"n": 3, "na')
    found = {(r.n, r.name, r.corrupt is not None) for r in read_json_objects(spark, f"file://{tmp_path}", "n bigint, name string").collect()}
    assert (2, "x", False) in found and any(c for _, _, c in found) and len(found) == 2


def test_a_lost_id_ends_the_job(spark):
    first = spark.createDataFrame([(1, "noise", "a"), (2, "noise", "b"), (3, "ambiguous", "c")], "review_id long, verdict string, note string")
    second = spark.createDataFrame([("1", "noise"), ("3", "noise")], "review_id string, verdict string")
    rows = {r.review_id: (r.verdict_1, r.verdict_2, r.note) for r in agreement.paired(first, second).collect()}
    assert rows == {"1": ("noise", "noise", "a"), "3": ("ambiguous", "noise", "c")}
    lost = second.unionByName(spark.createDataFrame([("9", "noise")], second.schema))
    with pytest.raises(Exception, match="lacks review 9"):
        agreement.paired(first, lost).collect()
    flagged = spark.createDataFrame([(1, 2), (2, 3)], "review_id long, rating_diff int")
    assert {r.review_id: r.rating_diff for r in agreement.with_distance(first.where("review_id < 3"), flagged).collect()} == {"1": 2, "2": 3}
    with pytest.raises(Exception, match="no flagged row for review 3"):
        agreement.agreement_by_distance(agreement.with_distance(first, flagged)).collect()


def test_gates_tell_what_is_missing(spark, sf):
    found = spark.createDataFrame([("a", 3), ("b", 0)], "name string, n long")
    assert {r.check: r.ok for r in checks.profile(found, ("a", "b", "c"), ("kept",)).collect()} == {"there: a": True, "there: b": False, "there: c": False, "there: kept": False}
    with pytest.raises(AssertionError, match="profile: there: b; profile: there: c"):
        checks.assert_ok(checks.profile(found, ("a", "b", "c"), ("kept",)))
    variants = spark.createDataFrame([("raw", "P4"), ("hard", "P4"), ("severe", "P4")], "variant string, proxy string")
    last = lambda v: [r.ok for r in checks.ablation(found, ("a", "P4"), v).collect()][-1]
    assert last(variants) and last(variants.limit(0)) and not last(variants.where("variant <> 'raw'")) and not last(variants.withColumn("proxy", F.lit("P1")))
    oks = [r.ok for r in q_runs.failing_gates(spark, sf).collect()]
    assert 5 < sum(oks) < len(oks) - 5


def test_splits_are_stored_once_and_pruned(spark, tmp_path):
    path, calls = f"file://{tmp_path}/e", []

    def made(seed):
        calls.append(seed)
        return spark.createDataFrame([(seed * 2,)], "x long")

    schema = "x long, split_seed int"
    assert sorted(map(tuple, by_split(spark, path, schema, made, (1, 2)).collect())) == [(2, 1), (4, 2)]
    both = by_split(spark, path, schema, made, (1, 2, 3))
    assert calls == [1, 2, 3] and both.count() == 3
    one = both.where("split_seed = 2")
    assert "PartitionFilters: [isnotnull(split_seed" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    assert read_partitions(spark, f"file://{tmp_path}/none", schema).count() == 0


def test_tail_against_the_error_function(spark):
    z = [0.0, 1e-6, 0.5, 1.0, 1.96, -2.5, 4.0, 8.0, 20.0, 37.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", significance.two_sided_p(F.col("z")).alias("p")).collect()
    for r in rows:
        want = math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p - want) <= 1.3e-7 * want  # the stated error of the approximation


def test_elongation_against_a_pattern(spark):
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\r é😀") * rng.choice([1, 1, 2, 3, 5]) for _ in range(30)) for _ in range(60)] + ["", "aaa", "\n\n\n\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.shorten(F.col("t")).alias("s")).collect()
    assert all(r.s == re.sub(r"(.)\1{2,}", r"\1\1", texts[r.i]) for r in rows)
