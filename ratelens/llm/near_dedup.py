"""MinHash near-duplicates with odd sketches.

Each distinct shingle set gets MinHash samples; bands of samples deal it to buckets, and all samples
are folded into a parity bitmap (odd sketch) whose XOR population count estimates high similarities
for the candidates. Candidates that the estimate can't rule out are confirmed on full shingle sets.

No pairs are made within a bucket beyond what connectivity needs: a bucket links its members to its
smallest one. Only where they don't end up in one component, members that can't have a link across
are ruled out by their unshared shingles, and the rest is tested exactly in tiles of bounded size,
which return just the links that join components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import HOT_KEYS, HOT_ROWS, hash_words, keys_for_join, materialize, mix64, release, runs, shingle_set, split_join, surrogates, table, text_hashes
from ratelens.llm.components import components

SKETCH_BITS = 512


@dataclass(frozen=True)
class NearConfig:
    """``percent``: 100 * intersection >= percent * union links two documents.

    With 30 bands of 4 samples a pair at the threshold of 80 (85) per cent misses all buckets with a
    probability of 1e-7 (2e-10).
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4
    seed: int = 11

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_different_bits(self) -> int:
        """Sketch bits in which a pair at the threshold differs at most, five sigmas out."""
        t, k = self.percent / 100, self.samples
        low = t - 5 * math.sqrt(t * (1 - t) / k)
        share = (1 - math.exp(-4 * k * (1 - low) / SKETCH_BITS)) / 2
        return math.ceil(SKETCH_BITS * share + 5 * math.sqrt(SKETCH_BITS * share * (1 - share)) / 2)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    return shingle_set(hash_words([text], lower=True)[0], size)


def signatures(sets: list[np.ndarray], config: NearConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set hashes (n, 2), band keys (n, bands) and odd sketches (n, bits / 64) of non-empty sets."""
    rng = np.random.default_rng(config.seed)
    flips = rng.integers(0, 2**32, config.samples, np.uint32)
    odds = rng.integers(0, 2**31, config.samples, np.uint32) * np.uint32(2) + np.uint32(1)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    marks = np.stack([np.add.reduceat(mix64(flat ^ np.uint64(config.seed)), starts), np.bitwise_xor.reduceat(mix64(flat + np.uint64(77)), starts)], axis=1)
    short = (flat >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(sets), config.samples), np.uint32)
    work = np.empty_like(short)
    for i in range(config.samples):
        np.bitwise_xor(short, flips[i], out=work)
        np.multiply(work, odds[i], out=work)
        low[:, i] = np.minimum.reduceat(work, starts)
    wide = low.astype(np.uint64)
    keys = np.empty((len(sets), config.bands), np.uint64)
    for b in range(config.bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(config.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, b * config.rows + r])
        keys[:, b] = key
    bit = mix64(wide + (np.arange(config.samples, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    at = (np.arange(len(sets), dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    parity = (np.bincount(at, minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(sets), SKETCH_BITS)
    return marks, keys, np.packbits(parity, axis=1).view(np.uint64)


def _featurer(config: NearConfig):
    names = ["doc_id", "h1", "h2", "n_shingles", "s1", "s2", "bands", "sketch"]

    def lists(matrix: np.ndarray) -> pa.Array:
        n, width = matrix.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(matrix.view(np.int64).ravel()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(x.as_py() for x in batch.column(1)):
                sets = [shingles(t, config.shingle) for t in texts]
                ids = [batch.column(k).slice(first, len(texts)) for k in (0, 2, 3)]
                full = np.array([bool(len(s)) for s in sets])
                sizes = pa.array([len(s) for s in sets], pa.int64())
                if full.any():
                    marks, keys, sketch = signatures([s for s in sets if len(s)], config)
                    at = pa.array(np.where(full, np.cumsum(full) - 1, 0), pa.int64(), mask=~full)
                    marks = marks.view(np.int64)
                    parts = [pa.array(marks[:, 0]), pa.array(marks[:, 1]), lists(keys), lists(sketch)]
                    columns = [p.take(at) for p in parts]
                else:
                    columns = [pa.nulls(len(sets), pa.int64())] * 2 + [pa.nulls(len(sets), pa.list_(pa.int64()))] * 2
                yield pa.RecordBatch.from_arrays([*ids, sizes, *columns], names)
        release()

    return features


def _verifier(config: NearConfig):
    """Each centre's text comes before those of its partners."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.empty(0, np.uint64)
        for batch in batches:
            partners, linked = [], []
            for i, (partner, text) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                own = shingles(text.as_py(), config.shingle)
                if not partner.is_valid:
                    centre = own
                    continue
                common = len(np.intersect1d(centre, own, assume_unique=True))
                partners.append(i)
                linked.append(100 * common >= config.percent * (len(centre) + len(own) - common) and common > 0)
            at = pa.array(partners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
        release()

    return verify


def different_bits(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _confirm(pairs: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """``a, b, linked`` for pairs, from the full shingle sets of whole texts."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    own = materialize(texts.join(keys_for_join(ids), "doc_id", "left_semi"), "texts")
    # A centre's partners are dealt to groups of bounded size; its text goes to each group once, ahead of them.
    most = max(HOT_ROWS, pairs.count() // HOT_KEYS)
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).alias("groups"))
    dealt = pairs.select("a", "b").join(F.broadcast(hot), "a", "left")  # at most HOT_KEYS rows
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).alias("part"), "b")
    centres = dealt.select("a", "part").distinct().join(own.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    partners = dealt.join(own.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    rows = centres.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialize(rows.mapInArrow(_verifier(config), "a long, b long, linked boolean"), "confirmed")


def near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    the whole text, or the whole sequence if it has fewer words. Null, empty and blank texts have no
    shingles and are linked with nothing. component_id is the smallest id reachable over links; kept
    is true for that document. Exact copies share one set and are never paired. Rows with the same id and text are one
    document, different texts under one id are documents of their own; rows without an id stand alone and are kept.
    An empty table gives no rows. A text of any length is hashed whole, in arrays of its words. Other columns are ignored.
    """
    return text_components(docs, config).drop("h1", "h2")


def text_components(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """``near_duplicates`` with two hashes of the text, ``h1, h2``, that tell rows of one id apart."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), *text_hashes(text))
    schema = "doc_id long, h1 long, h2 long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"
    found = materialize(texts.mapInArrow(_featurer(config), schema), "features")
    n = found.count()
    extra = materialize(surrogates(found.where("doc_id is not null and h1 is not null").select("doc_id", "h1")), "surrogates")
    several = not extra.isEmpty()
    if several:
        found = found.join(extra, ["doc_id", "h1"], "left").withColumn("node", F.coalesce("node", "doc_id"))
        texts = texts.join(keys_for_join(extra), ["doc_id", "h1"], "left").select(F.coalesce("node", "doc_id").alias("doc_id"), "text").distinct()
    else:
        found, texts = found.withColumn("node", F.col("doc_id")), texts.select("doc_id", "text")
    sets = found.where("node is not null and n_shingles > 0")
    classes = materialize(sets.groupBy("s1", "s2").agg(F.min("node").alias("node")), "classes")
    heads = sets.join(classes, ["s1", "s2", "node"], "left_semi").select("node", "bands", "sketch")
    heads = materialize(heads if not several else heads.dropDuplicates(["node"]), "heads")
    entries = heads.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("most")).where("first < most").select("key", "first")
    members = materialize(split_join(entries, materialize(shared, "shared"), ["key"], n * config.bands).select("key", "node", "first"), "members")
    sketches = materialize(heads.select("node", "sketch").join(members.select("node").distinct(), "node", "left_semi"), "sketches")
    comp = materialize(_link(members, sketches, texts, config), "linked")
    real = classes.join(comp, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("component"))
    if several:  # the least of a component may be a surrogate
        real = materialize(real, "real")
        named = found.join(real, ["s1", "s2"]).groupBy("component").agg(F.min("doc_id").alias("least"))
        real = real.join(named, "component").select("s1", "s2", F.col("least").alias("component"))
    placed = split_join(found.drop("bands", "sketch", "node"), materialize(real, "placed"), ["s1", "s2"], n, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "h1", "h2")


def _link(members: DataFrame, sketches: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """``node, comp`` of the members of shared buckets that are linked with any other."""
    pairs = materialize(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    close = (
        split_join(pairs, sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), ["a"], pairs.count())
        .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
        .select("a", "b", different_bits("x", "y").alias("bits"))
        .where(F.col("bits") <= config.most_different_bits)
    )
    close = materialize(close, "candidates")
    # Each member first meets its closest centre; most of its other candidates then lie in its component.
    best = close.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b")
    best = materialize(best, "best")
    checked = _confirm(best, texts, config)
    comp = materialize(components(checked.where("linked").select("a", "b")), "components")
    rest = _across(close.join(checked, ["a", "b"], "left_anti"), comp)
    rest = materialize(rest, "rest")
    if rest.isEmpty():
        return _closed(members, comp, texts, config)
    checked = _confirm(rest, texts, config)
    star = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    comp = materialize(components(star.union(checked.where("linked").select("a", "b"))), "components")
    return _closed(members, comp, texts, config)


def _closed(members: DataFrame, comp: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    links = _settle(members, comp, texts, config)
    star = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return comp if links.isEmpty() else components(star.union(links))


def _settle(members: DataFrame, comp: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """``a, b``: the links across components that buckets in two or more components still hide.

    Shingles that no other such member has can't be common to a pair. With c shared ones of n, a link
    to a set of n' needs c >= p (n + n') for p = percent / (100 + percent); a member for which even the
    smallest set of its bucket is too large is left out. The others are tested exactly, cluster by
    cluster (clusters are joined by buckets), in tiles of two blocks of bounded size: a task holds one
    tile and returns no more links than it joins components, so no pairs are made.
    """

    def open_buckets(state: DataFrame, fewest: int) -> DataFrame:
        keys = state.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
        return split_join(state, materialize(keys.where((F.col("low") < F.col("high")) & (F.col("n") >= fewest)).select("key"), "buckets"), ["key"], state.count(), "left_semi")

    state = members.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    state = materialize(open_buckets(materialize(state, "state"), 3), "open")  # a bucket of two has shown its only pair
    none = state.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("false")
    if state.isEmpty():
        return none
    nodes = materialize(state.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    own = texts.join(keys_for_join(nodes), "doc_id", "left_semi")
    sets = materialize(own.mapInArrow(_lister(config), "node long, grams binary").groupBy("node").agg(F.max("grams").alias("grams")), "sets")
    size = (F.length("grams") / 8).cast("long")
    grams = sets.mapInArrow(_exploder, "node long, gram long")
    common = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    shared = grams.join(common, "gram", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    facts = sets.select("node", size.alias("size")).join(shared, "node", "left").select("node", "size", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))
    known = materialize(state.join(facts, "node"), "known")
    least = known.groupBy("key").agg(F.min("size").alias("least"))
    able = (100 + config.percent) * F.col("shared") >= config.percent * (F.col("size") + F.col("least"))
    live = split_join(known, materialize(least, "least"), ["key"], known.count()).where(able).select("key", "node", "comp", "size")
    live = materialize(open_buckets(materialize(live, "able"), 2), "live")

    if live.isEmpty():
        return none
    first = live.groupBy("key").agg(F.min("node").alias("first"))
    joined = split_join(live, materialize(first, "first"), ["key"], live.count()).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    clusters = components(joined).withColumnRenamed("comp", "cluster")
    placed = live.select("node", "comp", "size").distinct().join(clusters, "node")
    # A cluster is dealt to as many blocks as its shingles fill, by a hash, so no task needs all of it in order.
    placed = materialize(placed, "clustered")
    fill = placed.groupBy("cluster").agg(F.ceil(F.sum("size") / TILE_SHINGLES).alias("blocks"))
    placed = split_join(placed, materialize(fill, "fill"), ["cluster"], placed.count())
    placed = materialize(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "placed")
    ends = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ends = ends.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
    tiles = ends.join(sets, "node").select("cluster", "i", "j", "block", "node", "comp", "grams")
    return materialize(tiles.groupBy("cluster", "i", "j").applyInPandas(_tile_tester(config.percent), "a long, b long"), "settled")


#: Shingles in a block; a tile of two blocks takes a few times 16 bytes for each. A larger set is a block of its own.
TILE_SHINGLES = 500_000


def tile_links(nodes: list[int], comps: list[int], sets: list[np.ndarray], left: list[bool], right: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and ``right`` that join different components, at most one a join."""
    parent: dict[int, int] = {c: c for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets])
    names, counts = np.unique(np.array(comps), return_counts=True)
    largest = int(names[np.argmax(counts)])
    # A pair across components has a row outside the largest one; that row asks, the other side is indexed.
    for asking, asked in ((left, right), (right, left)) if left != right else ((left, right),):
        rows = np.flatnonzero(np.array(asked))
        flat = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for x in np.flatnonzero(np.array(asking)):
            if comps[x] == largest:
                continue
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(rows))
            for k in np.flatnonzero(100 * common >= percent * (sizes[x] + sizes[rows] - common)):
                a, b = root(comps[x]), root(comps[rows[k]])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((nodes[x], nodes[rows[k]]))
    return found


def _tile_tester(percent: int):
    def test(tile: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(g, np.uint64) for g in tile["grams"]]
        left, right = (tile["block"] == tile["i"]).tolist(), (tile["block"] == tile["j"]).tolist()
        return pd.DataFrame(tile_links(tile["node"].tolist(), tile["comp"].tolist(), sets, left, right, percent), columns=["a", "b"], dtype="int64")

    return test


def _exploder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in runs((g.as_py() for g in batch.column(1)), 2_000_000):
            origin = np.repeat(np.arange(first, first + len(sets)), [len(g) // 8 for g in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin)), pa.array(np.frombuffer(b"".join(sets), np.int64))], ["node", "gram"])


def _lister(config: NearConfig):
    """The sorted shingle set of each text as one binary value."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), config.shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "grams"])
        release()

    return sets


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    one = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    two = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearConfig(shingle=3, percent=85))


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES: dict[str, str] = {}
