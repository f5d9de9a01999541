import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import components as steps
from ratelens.llm._common import ASCII_LOWER, WORD_BYTES, split_join
from ratelens.llm.components import components
from ratelens.llm.near_dedup import NearConfig, near_duplicates, op5_near_dedup

SCHEMA = "doc_id long, text string"


def brute(docs, size, percent):
    sets = {}
    for k, text in docs:
        w = WORD_BYTES.findall((text or "").encode().translate(ASCII_LOWER))
        n = min(size, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    comp = {k: k for k in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {k: (len(sets[k]), comp[k], comp[k] == k) for k in ids}


def run(spark, docs, config):
    rows = near_duplicates(spark.createDataFrame(docs, SCHEMA), config).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_edited_copies_match_brute_force(spark, size, percent):
    """A group whose members lie on both sides of the threshold, so that buckets stay in several components."""
    rng = random.Random(size)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(6)}"
        docs.append((k, " ".join(w)))
    docs += [(1000 + k, " ".join(f"v{rng.randrange(900)}" for _ in range(60))) for k in range(40)]
    docs += [(2000, docs[3][1]), (2001, docs[3][1].upper())]
    assert run(spark, docs, NearConfig(size, percent)) == brute(docs, size, percent)


def test_small_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "two one"), (8, "É a b c"), (9, "é a b c"), (10, "a b c d " * 5000)]
    assert run(spark, docs, NearConfig(3, 85)) == brute(docs, 3, 85)


def test_empty_null_and_repeated_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    found = near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [(-1, -1, True), (2, 2, True), (2, 2, True)]


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (2, a + " x"), (2, b), (2, b), (3, b + " y"), (4, "z"), (4, None)]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == [
        (1, 36, 1, True), (2, 36, 2, True), (2, 36, 2, True), (2, 37, 1, False), (3, 37, 2, False), (4, 0, 4, True), (4, 1, 4, True)]


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    from ratelens.llm import _common

    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k % 5 if k < 50 else k, k) for k in range(80)], "key long, v long").repartition(3)
    facts = spark.createDataFrame([(0, "a"), (1, "b"), (60, "c")], "key long, f string")
    for how in ("inner", "left", "left_semi"):
        expected = sorted(map(str, rows.join(facts, ["key"], how).collect()))
        assert sorted(map(str, _common.split_join(rows, facts, ["key"], 80, how).collect())) == expected


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8)], "doc_id long, text string, component_id int, s1 int")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (2, 1)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op5_near_dedup(spark, sf).collect()}
    assert got == brute(docs, 3, 85)


def test_word_hashes_tell_words_apart():
    from ratelens.llm._common import hash_words

    texts = [b"one two\tone", None, b"", b"  ", "é É ab ba a b aa".encode(), b"x" * 5000 + b" y", b"tail"]
    hashes, counts = hash_words(texts)
    words = [w for t in texts for w in WORD_BYTES.findall(t or b"")]
    assert counts.tolist() == [len(WORD_BYTES.findall(t or b"")) for t in texts]
    assert len(set(hashes.tolist())) == len(set(words)) and len({*zip(words, hashes.tolist())}) == len(set(words))
    assert hash_words([b"ABC \xc3\x89"], lower=True)[0].tolist() == hash_words([b"abc \xc3\x89"])[0].tolist()
    assert hash_words([b"two"])[0][0] == hashes[1]


def test_a_hub_is_verified_in_groups(spark, monkeypatch):
    """Partners of one centre beyond the bound of a group lie in several groups; each gets the centre's text once."""
    from ratelens.llm import near_dedup

    monkeypatch.setattr(near_dedup, "HOT_ROWS", 4)
    monkeypatch.setattr(near_dedup, "HOT_KEYS", 3)
    words = [f"w{k}" for k in range(60)]
    texts = {1: " ".join(words), **{k: " ".join([*words[: 60 - k % 20], *(f"x{k}y{i}" for i in range(k % 20))]) for k in range(2, 60)}}
    pairs = spark.createDataFrame([(1, k) for k in range(2, 60)] + [(5, 9), (5, 25), (8, 28)], "a long, b long")
    config = NearConfig(5, 80)
    rows = near_dedup._confirm(pairs, spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "doc_id long, text binary"), config).collect()
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    close = lambda a, b: 100 * len(grams(texts[a]) & grams(texts[b])) >= 80 * len(grams(texts[a]) | grams(texts[b]))
    assert sorted((r.a, r.b, r.linked) for r in rows) == sorted((r.a, r.b, close(r.a, r.b)) for r in pairs.collect())
    assert {r.linked for r in rows} == {True, False}


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    """Few edges are followed by one task and never by rounds of jobs; both ways name the smallest node."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 90, (70, 2))] + [(200, 200 + i) for i in range(1, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(steps, "FEW_EDGES", 0)
    rounds = {tuple(r) for r in components(df).collect()}
    monkeypatch.setattr(steps, "FEW_EDGES", 1000)
    monkeypatch.setattr(steps, "MAX_ROUNDS", 0)
    assert {tuple(r) for r in components(df).collect()} == rounds
    assert components(df.limit(0)).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_rows_pass_once(spark, how):
    """Hot keys with and without a fact, others, and null keys, as by a plain join; no semi join of the rows."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 1).when(F.col("id") < 2000, 2).when(F.col("id") < 2900, F.col("id")).alias("k"), "id")
    facts = spark.createDataFrame([(1, 7), (2500, 8), (9999, 9)], "k long, fact long")
    facts = facts if how != "left_semi" else facts.select("k")
    joined = split_join(rows, facts, ["k"], 3000, how)
    want = rows.join(facts, ["k"], how)
    assert joined.columns == want.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))
    if how != "left_semi":
        assert "LeftSemi" not in joined._jdf.queryExecution().executedPlan().toString()
