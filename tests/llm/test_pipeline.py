import random

import corpus_pipeline
from tests.llm.test_free_ops import check_pieces
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def naive_rules(text):
    """The seven rules of the production policy, spelled out."""
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.split()]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    letters = [c for c in text if c.isascii() and c.isalpha()]
    doubles, chars = len(lines) - len(set(lines)), sum(map(len, words))
    failed = [
        len(words) < 10, 100 * len(repeated) > 20 * len(words), 100 * sum(c in "#*$%&|<>" for c in text) > 25 * len(words), doubles > 2 and 100 * doubles > 30 * len(lines),
        bool(letters) and 100 * sum(c.isupper() for c in letters) > 40 * len(letters), chars > 20 * len(words), chars < 2 * len(words),
    ]
    return not any(failed)


def naive_cut(rows):
    """Exactly repeated windows of 50 words go from all but the first of the rows, which are in the order of documents."""
    seen, out = {}, []
    for k, (doc_id, text) in enumerate(rows):
        w = text.split()
        gone = set()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), k) != k:
                gone.update(range(i, i + 50))
        left = [x for i, x in enumerate(w) if i not in gone]
        if left:
            out.append((doc_id, left))
    return out


def naive_leak(words, item):
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    mine = grams(item)
    for s in range(max(1, len(words) - len(item) + 1)):
        own = grams(words[s : s + len(item)])
        common = sum(min(own.count(g), mine.count(g)) for g in set(own) & set(mine))
        if 100 * common >= 80 * (len(own) + len(mine) - common):
            return True
    return False


def test_stages_against_brute_force(spark, tmp_path):
    """Nulls, ties, repeated rows and ids, very long texts, clashing columns, copies, passages and leaks."""
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    item, p, near = text(40), text(70), text(150)
    edited = list(near)
    edited[70] = "edit"
    rows = [(k, text(rng.randrange(30, 120))) for k in range(25)]
    rows += [(30, near), (31, edited), (32, near), (32, text(60)), (33, text(40) + p + text(30)), (34, text(25) + p + text(50)), (35, p + text(20_000))]
    rows += [(40, text(30) + item + text(20)), (41, text(10) + item[:20] + ["x"] + item[21:] + text(10)), (42, text(30) + item[:20] + text(30)), (50, ["beat"] * 3000), (51, text(5)), (52, ["AB"] + [w.upper() for w in text(40)])]
    rows = [(k, " ".join(w)) for k, w in rows] + [(None, " ".join(text(40))), (None, None), (60, None), (61, ""), (62, " \n"), rows[3] and (3, " ".join(rows[3][1]))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], schema)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sf, extra = str(tmp_path), {"h1": "clash", "node": "clash", "kept": "clash", "n_words": "clash"}
    from pyspark.sql import functions as F

    docs = docs.withColumns({k: F.lit(v) for k, v in extra.items()})
    names = docs.columns
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    kept = corpus_pipeline.materialize(corpus_pipeline.quality_rules(spark, docs, sf), "t1")
    want = sorted(((k, t) for k, t in rows if naive_rules(t)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert of(kept) == want and kept.columns == names and 30 <= len(want) < len(rows) - 5

    unique = corpus_pipeline.materialize(corpus_pipeline.near_dedup(spark, kept, sf), "t2")
    known = [(k, t) for k, t in want if k is not None]
    texts = sorted(set(known))
    own = brute(list(enumerate(t for _, t in texts)), 5, 80)
    reps = {t for i, (_, t) in enumerate(texts) if own[i][2]}
    want = sorted([(k, t) for k, t in known if t in reps and k == min(i for i, u in known if u == t)] + [(k, t) for k, t in want if k is None], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert of(unique) == want and {31} & {k for k, _ in want} == set() and sum(k == 3 for k, _ in want) == 2 and sum(k == 32 for k, _ in want) == 1

    cut = corpus_pipeline.materialize(corpus_pipeline.substring_dedup(spark, unique, sf), "t3")
    kinds = [(k, t) for k, t in dict.fromkeys(want) if k is not None]
    left = dict(naive_cut(kinds))
    got = of(cut)
    assert {k: t.split() for k, t in got if k is not None} == left and sum(k is None for k, _ in got) == 1 and len(left[34]) == 75
    assert all(r.n_chars == len(r.text) for r in cut.collect()) and cut.columns == names

    clean = corpus_pipeline.materialize(corpus_pipeline.decontamination(spark, cut, sf), "t4")
    want = [(k, t) for k, t in got if k is None or not naive_leak(t.split(), item)]
    assert of(clean) == want and {40, 41, 42} & {k for k, _ in want} == {41, 42}

    pieces = corpus_pipeline.packing(spark, clean.where("doc_id <> 3 and doc_id is not null"), sf).collect()
    assert check_pieces(pieces, [(k, t) for k, t in want if k not in (3, None)], 4096) > 0.9
    run = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in run) == sum(r.doc_tokens for r in run if r.start == 0)
    assert sorted(str(r.doc_id) for r in run if r.start == 0) == sorted(str(k) for k, _ in want)


def test_run_keeps_every_token_once(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_doc.values():
        assert sum(p.length for p in parts) == parts[0].doc_tokens
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "repeated passages", "decontamination", "packing"]


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).isEmpty()
