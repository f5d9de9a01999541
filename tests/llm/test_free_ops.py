import gzip
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import packing, quality_rules, substring_dedup, warc
from ratelens.llm.language_id import HierarchicalModel, fit_languages, op8_language_id, predict_languages
from ratelens.llm.quality_classifier import LineField, Lines, fit_quality, forward_backward, line_features, op10_quality_classifier, score_quality
from tests.oracle import compare

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x"), (None, "y z"), (5, "naïve 中文 <|endoftext|> don't"), (6, "word " * 9000)]


@pytest.mark.parametrize("module", [quality_rules, warc])
def test_queries_match_sql(spark, sf, module):
    for name, sql in module.ORACLES.items():
        compare(spark, sf, module.QUERIES[name], sql)


# Packing


def encode(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, 2]


def check_pieces(rows, docs, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in docs:
        ids = encode(text)
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_pieces_cover_all_ids_with_little_padding(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_pieces(packing.op2_packing(spark, sf).collect(), docs, 4096) > 0.96


def test_packing_of_odd_texts(spark):
    docs = [d for d in ODD if d[0] != 4] + [(4, "x")]
    df = spark.createDataFrame(docs, DOCS).withColumn("unit", F.lit(1)).withColumn("rank", F.lit("clash"))
    pieces = packing.pack_documents(df, BPE, capacity=256, unit=4, with_ids=True)
    rows = pieces.collect()
    check_pieces(rows, docs, 256)
    total = sum(len(r.ids) for r in packing.sequences(spark.createDataFrame(rows, pieces.schema)).collect())
    assert total == 4 * sum(len(encode(t)) for _, t in docs)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), BPE).isEmpty()
    twice = packing.pack_documents(spark.createDataFrame([(4, "x"), (4, "x")], DOCS), BPE).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, 2}


def test_shuffled_offsets_give_the_same_cover(spark, monkeypatch):
    docs = [(i, f"a{i} b c " * (i % 50)) for i in range(300)]
    monkeypatch.setattr(packing, "BROADCAST_OFFSETS", 0)
    check_pieces(packing.pack_documents(spark.createDataFrame(docs, DOCS).repartition(5), BPE, 256, 4).collect(), docs, 256)


def test_cut_texts_have_the_tokenizers_ids():
    rng = random.Random(7)
    cache = packing.TokenIds(BPE)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 256), rng.randrange(32, 127), 32, 39, 115])) for _ in range(60)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x3000), 32])) for _ in range(60)) for _ in range(100)] + ["I'LL don't <|startoftext|>A <| b"]
    for text in texts:
        parts = cache.parts(text)
        got = b"".join(map(cache.learn(set(parts)).__getitem__, parts))
        assert got == np.asarray(encode(text)[:-1], "<u4").tobytes(), text


def test_other_tokenizers_are_left_to_themselves():
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.is_word_bpe(BPE) and not packing.is_word_bpe(other)
    texts = ["Ab  cd\nÉ 12", "x" * 3000]
    found = packing.token_ids(other)
    for t in texts:
        raw = b"".join(map(found.learn(set(found.parts(t))).__getitem__, found.parts(t)))
        assert np.frombuffer(raw, "<u4").tolist() == Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids


def test_least_squares_and_plan():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 30)), rng.random(20)
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-7 and np.abs(gradient[x > 0]).max() < 1e-7
    histogram = {1: 5, 7: 1000, 30: 400, 64: 3, 40: 17, 57: 900}
    plan = packing.make_plan(histogram, 64)
    filled = {}
    for u, n in histogram.items():
        for s, slot in zip(*plan.place(u, np.arange(n))):
            filled.setdefault(int(s), {})[int(slot)] = u
    assert sum(map(len, filled.values())) == sum(histogram.values()) and max(sum(v.values()) for v in filled.values()) <= 64
    assert sorted(filled) == list(range(plan.sequences))


# Passages


def test_sliding_minima():
    v = np.random.default_rng(2).integers(0, 1000, 200)
    for w in (1, 2, 5, 46, 64, 200):
        assert substring_dedup.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]


def brute_tree(values, begin, end, least):
    """(left, centre, right) of a Cartesian tree by its definition, the first of equal values on top."""
    out, todo = [], [(begin, end)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least:
            c = lo + int(np.argmin(values[lo:hi]))
            out.append((lo, c, hi - 1))
            todo += [(lo, c), (c + 1, hi)]
    return out


@pytest.mark.parametrize("top", [3, 50, 2**32])
def test_compact_windows_are_the_nodes_of_cartesian_trees(top):
    values = np.random.default_rng(3).integers(0, top, 300).astype(np.uint32)
    starts, ends = np.array([0, 5, 120, 120, 131]), np.array([0, 120, 120, 130, 300])
    for least in (1, 7, 46, 200):
        text, left, centre, right = substring_dedup.compact_windows(values, starts, ends, least)
        expected = sorted(x for a, b in zip(starts, ends) for x in brute_tree(values, int(a), int(b), least))
        assert sorted(zip(left.tolist(), centre.tolist(), right.tolist())) == expected
        assert all(starts[t] <= c < ends[t] for t, c in zip(text, centre))
        first, last = substring_dedup.shared_starts(left, centre, right, least)
        held = sorted((s, c) for s0, s1, c in zip(first.tolist(), last.tolist(), centre.tolist()) for s in range(s0, s1 + 1))
        assert held == [(s, s + int(np.argmin(values[s : s + least]))) for a, b in zip(starts, ends) for s in range(a, b - least + 1)]


def test_windows_with_enough_shared_minima_are_candidates():
    config = substring_dedup.PassageConfig(functions=4, enough=2)
    keys = np.array([16, 33, 48, 50, 67, 16], np.int64)  # functions 0, 1, 0, 2, 3, 0
    text, lo, hi = np.array([0, 0, 0, 0, 0, 1]), np.array([0, 4, 8, 20, 22, 0]), np.array([7, 10, 12, 30, 23, 9])
    found = substring_dedup.candidates(keys, text, lo, hi, config)
    assert sorted(zip(*(x.tolist() for x in found[1:]))) == [(0, 4, 7), (0, 8, 10), (0, 22, 23)]
    assert len(set(found[0].tolist())) == 3 and sorted(found[0] & 15) == [0, 0, 1]
    assert all(len(x) == 0 for x in substring_dedup.candidates(keys[:0], text[:0], lo[:0], hi[:0], config))


def passages(spark, docs):
    return {r.doc_id: r for r in substring_dedup.find_passages(spark.createDataFrame(docs, DOCS)).collect()}


def spans_of(row):
    return [(s.begin, s.end) for s in row.spans]


def words_of(seed):
    rng = random.Random(seed)
    return lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_planted_passages(spark):
    text = words_of(8)
    p, line, six = text(60), text(9), text(60)
    near = list(p)
    near[30] = "edit"
    docs = [(1, text(80) + p + text(80)), (2, text(30) + p), (3, p + text(200)), (4, text(50) + near + text(20)), (5, text(400)), (6, text(60) + p[:40] + text(60))]
    docs += [(100 + i, text(70) + line + text(70)) for i in range(40)] + [(20 + i, text(40) + six + text(40)) for i in range(6)]
    # An exact copy of a passage between overlapping fragments of it.
    docs += [(50, text(20) + [w for k in range(0, 45, 5) for w in p[k : k + 20]] + p + [w for k in range(0, 45, 5) for w in p[k : k + 20]])]
    docs = [(k, " ".join(t)) for k, t in docs] + [(7, " ".join(docs[4][1])), (8, None), (9, ""), (10, "short text"), (11, "short text")]
    got = passages(spark, docs)
    spans = {k: spans_of(r) for k, r in got.items() if r.spans}
    fragments = spans.pop(50)
    assert any(a <= 200 and b >= 260 for a, b in fragments)
    assert spans == {2: [(30, 90)], 3: [(0, 60)], 4: [(50, 110)], 7: [(0, 400)], **{20 + i: [(40, 100)] for i in range(1, 6)}}
    assert all(got[k].class_id == 1 and got[k].class_size == 5 for k in (1, 2, 3, 4, 50)) and got[7].class_id == 5 and got[6].class_id == 6
    assert all(got[20 + i].class_size == 6 and got[20 + i].class_id == 20 for i in range(6))
    assert got[6].class_size == 1 and got[8].n_words == 0 and got[11].class_id == 10 and got[11].n_repeated_words == 0


def test_an_owner_of_fragments_hides_no_copy(spark):
    text = words_of(12)
    p = text(60)
    fragments = [w for k in range(0, 45, 5) for w in p[k : k + 20]]
    got = passages(spark, [(1, " ".join(text(20) + fragments + p + fragments)), (2, " ".join(text(30) + p + text(30)))])
    assert spans_of(got[2]) == [(30, 90)]


def brute_windows(member, owner, config):
    sets = [[set(x[i : i + config.window].tolist()) for i in range(len(x) - config.window + 1)] for x in (member, owner)]
    return [any(100 * len(a & b) >= config.percent * len(a | b) for b in sets[1]) for a in sets[0]]


def test_windows_are_verified_as_sets():
    config = substring_dedup.PassageConfig()
    grams = lambda words: substring_dedup.gram_hashes(substring_dedup.mix64(np.array(words, np.uint64)), config.shingle)
    rng = np.random.default_rng(3)
    found = 0
    for vocabulary in [4, 40, 2000] * 30:
        owner = rng.integers(0, vocabulary, 160).tolist()
        a, k = int(rng.integers(0, 90)), int(rng.integers(0, 60))
        passage = owner[a : a + 60]
        passage = passage[k:] + passage[:k]
        passage[int(rng.integers(0, 60))] = 99999
        member, other = grams([*rng.integers(5000, 5020, 20), *passage, *rng.integers(5000, 5020, 20)]), grams(owner)
        good, hits = substring_dedup.matching_starts(substring_dedup.Content(member, config.window), substring_dedup.Content(other, config.window), config.percent)
        assert good.tolist() == brute_windows(member, other, config) and set(hits.tolist()) == set(np.flatnonzero(np.isin(member, other)).tolist())
        found += int(good.sum())
    assert found > 100


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("vocabulary", [30, 10**6])
def test_tiles_settle_all_windows_and_join_all_documents(vocabulary, across):
    config = substring_dedup.PassageConfig(words=14, shingle=3)
    rng = np.random.default_rng(4)
    base = rng.integers(0, vocabulary, 40)
    sets, nodes, blocks = [], [], []
    for k in range(40):
        own = base[int(rng.integers(0, 12)) :][: int(rng.integers(16, 30))].copy()
        for e in rng.integers(0, len(own), int(rng.integers(0, 4))):
            own[e] = rng.integers(10**6, 10**7)
        sets.append(substring_dedup.gram_hashes(substring_dedup.mix64(own.astype(np.uint64)), 3))
        nodes.append(int(rng.integers(0, 30)))
        blocks.append(nodes[-1] % 2 if across else 0)
    good = {k: np.zeros(len(s) - config.window + 1, bool) for k, s in enumerate(sets)}
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j, first, last, begin, end in substring_dedup.tile_links(blocks, nodes, sets, config):
        assert nodes[j] < nodes[i] and first <= begin < end <= last + config.words
        good[i][first : last + 1] = True
        parent[max(root(nodes[i]), root(nodes[j]))] = min(root(nodes[i]), root(nodes[j]))
    joined = {n: root(n) for n in nodes}
    expected, parent = {k: np.zeros(len(v), bool) for k, v in good.items()}, {n: n for n in nodes}
    for i in range(40):
        for j in range(40):
            if nodes[j] < nodes[i] and not (across and blocks[i] == blocks[j]):
                found = np.array(brute_windows(sets[i], sets[j], config))
                expected[i] |= found
                if found.any():
                    parent[max(root(nodes[i]), root(nodes[j]))] = min(root(nodes[i]), root(nodes[j]))
    assert all((good[k] == expected[k]).all() for k in good) and joined == {n: root(n) for n in nodes}
    assert sum(v.sum() for v in good.values()) > 20


@pytest.mark.parametrize("tile", [250_000, 400])
def test_passages_against_brute_force(spark, monkeypatch, tile):
    """All windows of a small corpus with near-duplicates behind a common line, repetitive texts and swapped halves."""
    monkeypatch.setattr(substring_dedup, "TILE_SHINGLES", tile)
    config = substring_dedup.PassageConfig()
    text = words_of(10)
    line, beat, p = text(34), text(12), text(70)
    docs = [(i, text(25) + line + text(25)) for i in range(8)]
    for i in range(6):
        q = text(8) + line + text(8)
        docs.append((100 + i, text(25) + q + text(25)))
        q[4] = "edit"
        docs.append((200 + i, text(25) + q + text(25)))
    docs += [(300 + i, text(20) + beat * 6 + text(20 + i)) for i in range(4)] + [(400, p + text(20)), (401, text(9) + p[35:] + p[:35]), (402, text(30) + p[:30] + ["x"] + p[31:])]
    got = passages(spark, [(k, " ".join(w)) for k, w in docs])
    grams = {k: substring_dedup.gram_hashes(substring_dedup.hash_words([" ".join(w).encode()])[0], config.shingle) for k, w in docs}
    ids, missed, total = sorted(grams), 0, 0
    parent = {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, b in enumerate(ids):
        covered = np.zeros(len(grams[b]) + config.shingle - 1, bool)
        for begin, end in spans_of(got[b]):
            covered[begin:end] = True
        good = np.zeros(len(grams[b]) - config.window + 1, bool)
        for a in ids[:n]:
            if len(np.intersect1d(grams[a], grams[b])) >= 8:
                found = np.array(brute_windows(grams[b], grams[a], config))
                good |= found
                if found.any():
                    parent[max(root(a), root(b))] = min(root(a), root(b))
        # Inner words of windows; up to ten at either end may have no shingle in common.
        missed += sum(not covered[s + 10 : s + 40].all() for s in np.flatnonzero(good))
        total += int(good.sum())
        assert good.any() or not covered.any()
    assert total > 100 and missed <= 0.01 * total
    wrong = [k for k in ids if got[k].class_id != root(k)]
    assert len(wrong) <= 1 and all(got[k].class_size == sum(r.class_id == got[k].class_id for r in got.values()) for k in ids)


def test_passages_of_odd_tables(spark):
    """Very long and repeated rows, several texts under one id, rows without an id, clashing columns."""
    text = words_of(13)
    a, b, p = " ".join(text(100)), " ".join(text(100)), text(55)
    long = " ".join(text(60_000) + p)
    rows = [(1, a), (1, a), (2, a + " x"), (2, b), (3, " ".join(p) + " " + b), (None, a), (4, long), (5, "beat " * 5000), (6, "beat " * 5000)]
    docs = spark.createDataFrame([(*r, 0, "h", 1) for r in rows], DOCS + ", node long, key string, h1 int")
    got = [(r.doc_id, r.class_id, r.class_size, r.n_words, spans_of(r)) for r in substring_dedup.find_passages(docs).collect()]
    # Of the texts under one id that of the greater hash comes after all ids: document 3 owns the passage.
    expected = [(1, 1, 2, 100, []), (1, 1, 2, 100, []), (2, 1, 2, 101, [(0, 100)]), (2, 2, 3, 100, [(0, 100)]), (3, 2, 3, 155, []), (None, None, 1, 100, [])]
    expected += [(4, 2, 3, 60_055, [(60_000, 60_055)]), (5, 5, 2, 5000, []), (6, 5, 2, 5000, [(0, 5000)])]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert substring_dedup.find_passages(docs.where("false")).isEmpty()


def test_removal(spark):
    assert substring_dedup.remove_words("a  b c\né f", [(1, 3)]) == "a  \né f"
    assert substring_dedup.remove_words("a b", [(0, 2)]) == "" and substring_dedup.remove_words("a b", []) == "a b"
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    cut = docs.where("doc_id = 1").select("doc_id", F.expr("array(named_struct('begin', 1, 'end', 2))").alias("spans"), *substring_dedup.text_hashes(F.col("text")))
    other = docs.union(spark.createDataFrame([(1, "d e f", "z")], docs.schema))
    assert sorted((r.doc_id, r.text, r.lang) for r in substring_dedup.remove_passages(other, cut).collect()) == [(1, "a  c", "x"), (1, "d e f", "z"), (2, None, "y")]
    assert substring_dedup.find_passages(spark.createDataFrame([], DOCS)).isEmpty()


# Archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(spark, tmp_path, version):
    html = [(1, "http://a b/\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50000), (None, "u", "same"), (7, "u", "same"), (7, "u", "\r\n\r\nX-Page-Id: 3")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").repartition(3)
    arcs = warc.write_arc(pages, f"file://{tmp_path}/arc", version)
    back = warc.read_warcs(warc.arc_to_warc(arcs, f"file://{tmp_path}/warc")).collect()
    import base64
    import hashlib

    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(p, len((t or "").encode()), digest(t)) for p, _, t in html]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.page_id, r.payload_bytes, r.payload_digest) for r in back) == order(want)
    types = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to) for r in back}
    assert types[1, digest("same")] == ("response", None) and types[2, digest("same")] == types[7, digest("same")] == types[None, digest("same")] == ("revisit", 1)
    assert types[3, digest("")] == ("response", None) and types[4, digest("")] == ("revisit", 3)
    assert len({r.record_id for r in back}) == len(back)


def test_damaged_archives_raise():
    head = b"filedesc://x 0.0.0.0 20240101000000 text/plain 76\n"
    body = f"1 0 o\n{warc.FIELDS[1]}\n".encode()
    good = head.replace(b"76", str(len(body)).encode()) + body + b"\n" + b"http://x 0.0.0.0 2024 text/html 3\nabc\n"
    (record,) = warc.read_arc(io.BytesIO(good))
    assert record.block == b"abc" and record.fields["Archive-date"] == "2024" and warc.iso_date("2024") == "2024-00-00T00:00:00Z"
    for bad in (good[:-3], good.replace(b"html 3", b"html x"), good.replace(b" text/html", b""), good.replace(b"1 0 o", b"7 0 o")):
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        list(warc.read_warc(io.BytesIO(warc.warc_record([("WARC-Record-ID", "i")], b"abc").replace(b"abc", b"abd"))))
    assert gzip.decompress(gzip.compress(b"x", 1, mtime=0)) == b"x"


def test_no_pages(spark, tmp_path):
    arcs = warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    assert warc.read_warcs(warc.arc_to_warc(arcs, f"file://{tmp_path}/w")).isEmpty()


# Rules


def test_measurements_of_odd_texts(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumn("n_words", F.lit("clash"))
    got = sorted(((r.doc_id or -1, r.n_words, r.word_chars, r.n_repeat_words) for r in quality_rules.rule_ledger(df).collect()))
    assert got[:5] == [(-1, 2, 2, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 1, 0)] and got[-1] == (6, 9000, 36000, 9000)
    kept = quality_rules.keep_by_ledger(df, quality_rules.stored_ledger(df))
    assert kept.columns == df.columns and kept.isEmpty()
    clean = " ".join(f"word{k}" for k in range(30))
    two = spark.createDataFrame([(1, clean), (1, "bad"), (None, clean), (None, "bad"), (2, clean)], DOCS)
    assert sorted((r.doc_id or 0, r.text) for r in quality_rules.keep_by_ledger(two, quality_rules.stored_ledger(two)).collect()) == [(0, clean), (1, clean), (2, clean)]
    assert quality_rules.rule_ledger(spark.createDataFrame([], DOCS)).isEmpty()


def test_ablation_counts(spark, sf):
    ledger = quality_rules.rule_ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r.failed_bits for r in ledger.collect()]
    for r in quality_rules.ablation(ledger, "v2").collect():
        mask, flag = quality_rules.POLICIES["v2"], 1 << r.bit
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(bool(b & flag) for b in bits), sum(b & mask == flag for b in bits), sum(b & mask & ~flag == 0 for b in bits))


# Classifiers


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op8_language_id(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_odd_texts(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abc " if i % 2 else "xyz ") for _ in range(80)), "en" if i % 2 else "fr") for i in range(80)]
    docs = spark.createDataFrame([*rows, (90, None, "en"), (91, "12 !", "en"), (92, "", None), (None, "abc", "en")], "doc_id long, text string, lang string")
    model = fit_languages(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(docs, model).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[1][0] == "en" and got[2][0] == "fr" and got[None][0] == "en"
    assert {r.lang_pred for r in predict_languages(docs, fit_languages(docs.where("false"))).collect()} == {"und"}
    assert isinstance(model, HierarchicalModel) and set(model.within) == {"germanic", "romance"}
    odd = spark.createDataFrame([(1, "abc " * 200_000, "x"), (2, "xyz", "y"), (2, "xyz", "z")], docs.schema).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s"))
    found = predict_languages(odd, model).collect()
    assert [r.lang_pred for r in found if r.doc_id == 1] == ["en"] and len({(r.lang_pred, r.score) for r in found if r.doc_id == 2}) == 1 and len(found) == 3
    assert predict_languages(odd.where("false"), model).isEmpty()


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 4])
    emission, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    good, norm, pairs = forward_backward(emission, counts, transition)
    import itertools

    at, total = 0, np.zeros((2, 2))
    for c, n in enumerate(counts):
        weights = {}
        for labels in itertools.product((0, 1), repeat=int(n)):
            weights[labels] = np.exp(sum(emission[at + i] * k for i, k in enumerate(labels)) + sum(transition[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        assert np.isclose(np.log(z), norm[c])
        for i in range(n):
            assert np.isclose(good[at + i], sum(w for k, w in weights.items() if k[i]) / z)
        for k, w in weights.items():
            for a, b in zip(k, k[1:]):
                total[a, b] += w / z
        at += n
    assert np.allclose(total, pairs)


@pytest.mark.parametrize("steps", [1, 4])
def test_scans_of_long_chains_equal_steps(monkeypatch, steps):
    from ratelens.llm import quality_classifier

    rng = np.random.default_rng(5)
    counts = np.array([3, 1, 70, 2, 9, 128, 5])
    emission, transition = rng.normal(size=counts.sum()) * 3, rng.normal(size=(2, 2))
    by_step = forward_backward(emission, counts, transition)
    monkeypatch.setattr(quality_classifier, "STEPS", steps)
    assert all(np.allclose(a, b) for a, b in zip(by_step, forward_backward(emission, counts, transition)))


def test_many_lines_take_no_step_each(spark):
    import time

    field = LineField(np.ones(43) / 10, np.eye(2))
    text = "one line\n" * 300_000
    start = time.perf_counter()
    field.score(line_features([text.encode()]))
    assert time.perf_counter() - start < 10
    docs = spark.createDataFrame([(1, text), (1, "a"), (2, "a"), (2, "a")], DOCS).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))
    got = score_quality(docs, field).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 2}) == 1 and score_quality(docs.where("false"), field).isEmpty()


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op10_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(label[r.doc_id] == r.predicted for r in rows) / len(rows) > 0.93


def test_quality_of_odd_texts(spark):
    df = spark.createDataFrame(ODD, DOCS)
    field = LineField(np.zeros(43), np.zeros((2, 2)))
    scores = score_quality(df, field).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    labels = spark.createDataFrame([(1, 1), (4, None)], "doc_id long, quality int")
    assert fit_quality(df, labels) is None and {r.score for r in score_quality(df, None).collect()} == {0.5}
    lines = line_features([None, b"a\nb", b"\n\n"])
    assert isinstance(lines, Lines) and lines.counts.tolist() == [1, 2, 3] and lines.lengths.sum() == 2
