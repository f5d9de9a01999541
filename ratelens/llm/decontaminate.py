"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

A window of a document has as many words as a benchmark item. Windows that hold too few of the shingles of
all items of that size can't reach the similarity, in whatever order the shingles stand; all others get a fingerprint.
Windows and items of a size meet through a multi-index: the 64 bits are cut into five
blocks, and two fingerprints within ``RADIUS`` bits must agree in one block up to ``BLOCK_RADIUS``
bits, so joining on every block with all its near variants of the items finds all of them. Candidates
within the radius are verified by the exact weighted similarity of their shingles.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import WORD_SQL, keys_for_join, materialize, table, text_hashes

SHINGLE, PERCENT = 5, 80
BLOCK_BITS, BLOCK_RADIUS = (13, 13, 13, 13, 12), 3
#: Two sets of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9; of unrelated ones one pair in 1200 is within 19.
RADIUS = len(BLOCK_BITS) * (BLOCK_RADIUS + 1) - 1
#: Items of at most this many shingles in all are broadcast, with their places, and so is an index of at most this many entries.
BROADCAST_GRAMS = 500_000
#: Shingles of a text that stay together (or those of the longest item, if it has more), and of a chunk's windows.
PIECE, CHUNK_GRAMS = 4096, 65_536
KEY = ["doc_id", "h1", "h2"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_SQL})"), 1)


def grams(of: str) -> Column:
    """Shingle hashes of a word array, in order; empty for fewer words than a shingle has."""
    at = F.sequence(F.lit(0), F.size(of) - SHINGLE)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(of), i + k) for k in range(SHINGLE))))
    return F.when(F.size(of) >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))


def simhash(of: Column) -> Column:
    """Bit b is set if more than half of the shingles have it; repeated shingles count as often."""
    masks = F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    marked = F.transform(masks, lambda m: F.when(2 * F.size(F.filter(of, lambda g: g.bitwiseAND(m) != 0)) > F.size(of), m).otherwise(F.lit(0).cast("long")))
    return F.aggregate(marked, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))


def block(of: str, b: int) -> Column:
    return F.shiftrightunsigned(F.col(of), sum(BLOCK_BITS[:b])).bitwiseAND(F.lit((1 << BLOCK_BITS[b]) - 1))


def blocks(of: str) -> Column:
    """``b, value`` of every block."""
    return F.array(*(F.struct(F.lit(b).alias("b"), block(of, b).alias("value")) for b in range(len(BLOCK_BITS))))


def near_blocks(of: str) -> Column:
    """The same with all values at most ``BLOCK_RADIUS`` bits away."""

    def masks(bits: int) -> list[int]:
        return [sum(1 << b for b in at) for n in range(BLOCK_RADIUS + 1) for at in itertools.combinations(range(bits), n)]

    def around(b: int) -> Column:
        flips = F.from_json(F.lit(str(masks(BLOCK_BITS[b]))), "array<bigint>")
        return F.transform(flips, lambda m: F.struct(F.lit(b).alias("b"), m.bitwiseXOR(block(of, b)).alias("value")))

    return F.flatten(F.array(*(around(b) for b in range(len(BLOCK_BITS)))))


def common_weight(x: str, y: str) -> Column:
    """Sum over shingles of the smaller of their two counts."""
    a, b = F.col(x), F.col(y)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))

    def count(of: Column, g: Column) -> Column:
        return F.size(F.filter(of, lambda v: v == g))

    weighted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, g: s + F.least(count(a, g), count(b, g)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(weighted)


def _chunks(windows: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """``windows`` (n, start, placed) gathered in chunks of neighbours, with the shingles ``part`` of each chunk, which begins at ``low``.

    A chunk has at most ``n`` windows and ``CHUNK_GRAMS`` shingles in all of them (or one window), so no row grows with the text.
    """
    per = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(CHUNK_GRAMS / F.col("n")).cast("int")))
    dealt = windows.withColumns({"c": F.floor(F.col("start") / size).cast("int"), "d": F.floor(F.col("start") / per).cast("int")})
    chunks = dealt.groupBy(*KEY, "n", "c", "d").agg(F.collect_list(F.struct("start", "placed")).alias("windows"), F.min("start").alias("low"), F.max("start").alias("high"))
    part = F.slice("piece", F.col("low") - F.col("c") * size + 1, F.col("high") - F.col("low") + F.col("n") - (SHINGLE - 1))
    return chunks.join(pieces, [*KEY, "c"]).select(*KEY, "n", "low", "windows", part.alias("part"))


def _sliced(chunks: DataFrame) -> DataFrame:
    """``start, placed, window_grams`` of every window."""
    cut = F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["placed"].alias("placed"), F.slice("part", x["start"] - F.col("low") + 1, F.col("n") - (SHINGLE - 1)).alias("window_grams")))
    return chunks.select(*KEY, "n", F.explode_outer(cut).alias("x")).select(*KEY, "n", "x.*")


def _marked(chunks: DataFrame, widest: int) -> DataFrame:
    """``start, placed, mark`` of every window: ``simhash`` by running counts, which a chunk's windows share.

    The counts of several bits lie side by side in a long, each wide enough for a chunk; a window's are those at its end
    less those at its start.
    """
    bits = max(1, (2 * widest).bit_length())
    lanes = 63 // bits
    groups = [range(b, min(64, b + lanes)) for b in range(0, 64, lanes)]

    def spread(g: Column, of: range) -> Column:
        ones = [F.shiftleft(F.shiftrightunsigned(g, b).bitwiseAND(F.lit(1).cast("long")), bits * k) for k, b in enumerate(of)]
        return functools.reduce(lambda x, y: x.bitwiseOR(y), ones)

    def running(of: range) -> Column:
        return F.aggregate("part", F.array(F.lit(0).cast("long")), lambda sums, g: F.concat(sums, F.array(F.element_at(sums, -1) + spread(g, of))))

    counted = chunks.select(*KEY, "n", "low", "windows", F.size("part").alias("length"), F.array(*(running(of) for of in groups)).alias("sums"))

    def own(x: Column) -> Column:
        first = x["start"] - F.col("low")
        end = F.least(first + F.col("n") - (SHINGLE - 1), F.col("length"))
        return F.struct(x["start"].alias("start"), x["placed"].alias("placed"), (end - first).alias("count"), F.transform("sums", lambda s: F.get(s, end) - F.get(s, first)).alias("counts"))

    each = counted.select(*KEY, "n", F.explode_outer(F.transform("windows", own)).alias("x")).select(*KEY, "n", "x.*")

    def bit(j: int, k: int, b: int) -> Column:
        ones = F.shiftrightunsigned(F.get("counts", F.lit(j)), bits * k).bitwiseAND(F.lit((1 << bits) - 1))
        return F.when(2 * ones > F.col("count"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    mark = functools.reduce(lambda x, y: x.bitwiseOR(y), [bit(j, k, b) for j, of in enumerate(groups) for k, b in enumerate(of)])
    return each.select(*KEY, "n", "start", "placed", mark.alias("mark"))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, similarity, start`` for every document and item that some window matches.

    Words are runs without ASCII white space of the lower-cased text, shingles have five words and
    weigh as often as they occur; similarity is the sum of the smaller weights over that of the larger,
    ``start`` the first word of the best window (of equal ones the first that one of its shingles places
    where it stands in an item, else the first). A document shorter than an
    item is one window. Items of fewer than five words are too short to tell and match nothing, as do
    null and empty texts on either side and rows without an id. Repeated rows count once, and of different texts under one
    id the best match; an empty table gives no rows. Other columns are ignored. Texts are read whole; a row holds a few arrays
    of a text's words, whatever its length. Its windows are rows of their own, which meet their shingles in pieces of bounded size.
    """
    best = matched_texts(docs, items, percent).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.back")).alias("start"))


def matched_texts(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, h1, h2, item_id, best`` for every text (told by its id and hashes) and item that some window matches."""
    listed = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).distinct()
    listed = listed.select("item_id", F.size("w").alias("n"), grams("w").alias("item_grams")).where(F.col("n") >= SHINGLE)
    listed = materialize(listed.withColumn("item_mark", simhash(F.col("item_grams"))), "items")
    places = listed.select("n", F.posexplode("item_grams").alias("o", "g")).distinct()
    total = places.count()

    text = F.col("text").cast("string")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes(text), text.alias("text"))
    cut = texts.select(*KEY, words(F.col("text")).alias("w")).select(*KEY, F.size("w").alias("len"), grams("w").alias("grams"))
    # The outer form here and below, as the filter that is inferred for the other would compute the arrays once more, for each element of a lambda.
    spots = cut.select(*KEY, "len", F.posexplode_outer("grams").alias("p", "g"))
    hits = spots.join(F.broadcast(places) if total <= BROADCAST_GRAMS else places, "g")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("o"), F.col("len") - F.col("n")))
    sized = hits.groupBy(*KEY, "len", "n").agg(F.sort_array(F.collect_set("p")).alias("at"), F.collect_set(start).alias("placed"))  # bounded by the text
    width = F.least("len", "n") - (SHINGLE - 1)
    fewest = F.ceil(percent * (width + F.col("n") - (SHINGLE - 1)) / (100 + percent)).cast("int")
    sized = sized.select(*KEY, "len", "n", "at", "placed", width.alias("width"), fewest.alias("fewest")).where(F.size("at") >= F.col("fewest"))
    last = F.greatest(F.lit(0), F.col("len") - F.col("n"))

    def reach(i: Column) -> Column:
        """Starts of windows that hold the i-th hit and the ``fewest`` - 1 after it, without those that the hit before it gives."""
        low = F.greatest(F.lit(0), F.get("at", i + F.col("fewest") - 1) - F.col("width") + 1, F.get("at", i - 1) + 1)
        return F.struct(low.alias("lo"), F.least(F.get("at", i), last).alias("hi"))

    ranges = F.filter(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("fewest")), reach), lambda r: r["lo"] <= r["hi"])
    found = sized.select(*KEY, "n", "placed", F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"]))).alias("starts"))

    def told(of: Column, placed: bool) -> Column:
        return F.transform(of, lambda s: F.struct(s.alias("start"), F.lit(placed).alias("placed")))

    each = F.concat(told(F.array_intersect("starts", "placed"), True), told(F.array_except("starts", "placed"), False))
    windows = materialize(found.select(*KEY, "n", F.explode_outer(each).alias("x")).select(*KEY, "n", "x.start", "x.placed").where("start is not null"), "windows")
    widest = listed.agg(F.max("n")).first()[0] or 0
    size = max(PIECE, widest)
    own = texts.join(keys_for_join(windows.select(*KEY).distinct()), KEY, "left_semi").dropDuplicates(KEY)
    whole = own.select(*KEY, words(F.col("text")).alias("w")).select(*KEY, grams("w").alias("grams"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("grams") - 1) / size).cast("int"))), lambda c: F.slice("grams", c * size + 1, 2 * size))
    pieces = materialize(whole.select(*KEY, F.posexplode_outer(parts).alias("c", "piece")), "pieces")
    marked = materialize(_marked(_chunks(windows, pieces, size), widest), "marked")

    index = listed.select("item_id", "n", "item_mark", F.explode(near_blocks("item_mark")).alias("at")).select("item_id", "n", "item_mark", "at.b", "at.value")
    probes = marked.select(*KEY, "n", "start", "placed", "mark", F.explode(blocks("mark")).alias("at")).select(*KEY, "n", "start", "placed", "mark", "at.b", "at.value")
    near = probes.join(F.broadcast(index) if index.count() <= BROADCAST_GRAMS else index, ["n", "b", "value"])
    near = near.where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= RADIUS)
    # A pair that agrees in several blocks is taken at the first of them.
    agree = [F.bit_count(block("mark", b).bitwiseXOR(block("item_mark", b))) <= BLOCK_RADIUS for b in range(len(BLOCK_BITS))]
    near = near.where(F.col("b") == F.coalesce(*(F.when(a, F.lit(b)) for b, a in enumerate(agree)))).select(*KEY, "n", "start", "placed", "item_id")
    near = materialize(near, "near")
    # The items are read once more for their shingles; their size is that of the table of places, counted above.
    full = listed.select("item_id", "item_grams")
    cut = _sliced(_chunks(near.select(*KEY, "n", "start", "placed").distinct(), pieces, size))
    near = near.drop("placed").join(cut, [*KEY, "n", "start"]).join(F.broadcast(full) if total <= BROADCAST_GRAMS else full, "item_id")
    both = F.size("window_grams") + F.size("item_grams")
    scored = near.select(*KEY, "item_id", "start", "placed", common_weight("window_grams", "item_grams").alias("common"), both.alias("both"))
    matched = scored.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common")))
    similarity = F.col("common") / (F.col("both") - F.col("common"))
    best = matched.select(*KEY, "item_id", F.struct(similarity.alias("similarity"), "placed", (-F.col("start").cast("long")).alias("back")).alias("best"))
    return best.groupBy(*KEY, "item_id").agg(F.max("best").alias("best"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All windows that share a shingle with an item of their size: others have similarity 0.
OP3_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ig AS (SELECT DISTINCT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS o, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM iw WHERE len(w) > 4),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, len(w) AS len, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM dw WHERE len(w) > 4),
ic AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
it AS (SELECT item_id, sum(c) AS total FROM ic GROUP BY ALL),
hit AS (SELECT doc_id, len, n, item_id, p, g, c FROM dg JOIN ic USING (g)),
inw AS (SELECT doc_id, len, n, item_id, g, c, unnest(range(greatest(0, p - n + 5), least(p, greatest(0, len - n)) + 1)) AS start FROM hit),
wc AS (SELECT doc_id, len, n, item_id, start, g, least(count(*), any_value(c)) AS common FROM inw GROUP BY doc_id, len, n, item_id, start, g),
s AS (SELECT doc_id, n, item_id, start, any_value(least(len, n) - 4) AS total, sum(common) AS common FROM wc GROUP BY doc_id, n, item_id, start),
pl AS (SELECT DISTINCT doc_id, n, greatest(0, least(p - o, len - n)) AS start, TRUE AS placed FROM dg JOIN (SELECT DISTINCT n, o, g FROM ig) USING (g)),
m AS (SELECT s.doc_id, s.item_id, s.start, coalesce(placed, FALSE) AS placed, common / (s.total + it.total - common)::DOUBLE AS similarity
  FROM s JOIN it USING (item_id) LEFT JOIN pl ON s.doc_id = pl.doc_id AND s.n = pl.n AND s.start = pl.start WHERE 100 * common >= 80 * (s.total + it.total - common))
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, arg_max(start, (similarity, placed, -start))::BIGINT AS start FROM m GROUP BY doc_id, item_id
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": OP3_SQL}
