"""What ordered filters do to each other: incidence matrix products.

Every document is reduced to a mask with a bit for each filter it fails, every part of the table to histograms over the
masks: of all documents, of good ones and of toxic ones. All outcomes of all orders of the filters are then products of these
rows with fixed 0/1 matrices of (masks x (order, step)), so no order is ever applied to a document.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, release, small_batches, table


@dataclass(frozen=True)
class Filter:
    """A filter on whole texts; ``fails`` gets the UTF-8 bytes, the number of code points and the words (as bytes)."""

    name: str
    fails: Callable[[bytes, int, list[bytes]], bool]


_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"

#: Comparisons are of integers, so every engine gets the same.
FILTERS = (
    Filter("A", lambda raw, points, words: len(words) < 50),
    Filter("B", lambda raw, points, words: 100 * len(set(words)) < 65 * len(words)),
    Filter("C", lambda raw, points, words: 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * points),
    Filter("D", lambda raw, points, words: len(raw) > len(raw.translate(None, _MARKS))),
)
#: The filter that looks at the whole table: the text is that of a smaller id as well.
COPY = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _measurer(filters: Sequence[Filter]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            points = pc.utf8_length(texts).to_pylist()
            masks, digests = [], []
            for text, n in zip(texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()), points, strict=True):
                raw = text.as_py()
                words = raw.split()  # bytes part at \x20 and \x09-\x0D alone
                masks.append(sum(1 << i for i, f in enumerate(filters) if f.fails(raw, n, words)))
                digests.append(hashlib.sha256(raw).digest()[:16])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "own_mask"])
        release()

    return run


def failure_masks(docs: DataFrame, filters: Sequence[Filter] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, n, mask``: for rows of one id, part and text their number and the filters they fail.

    Bit i stands for ``filters[i]``, the next one for a text that a smaller id has as well, wherever in the table.
    Null texts are empty ones, null parts the empty string. A row without an id is neither smaller nor greater than
    another, so it is no copy and makes none. Texts are read once, whole, one at a time; only narrow rows are
    shuffled. Copies are found through the smallest id of each text, a map-side minimum, and a join on (text, id), so a text
    that a third of all rows share is no hot key.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = kind.mapInArrow(_measurer(filters), "doc_id long, part string, digest binary, own_mask int")
    rows = materialize(rows.groupBy("doc_id", "part", "digest", "own_mask").agg(F.count("*").alias("n")), "masks")
    named = rows.where(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), F.lit(1 << len(filters))).otherwise(F.lit(0))
    told = named.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", "n", (F.col("own_mask") + copy).alias("mask"))
    return told.unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "part", "n", F.col("own_mask").alias("mask")))


def histograms(masks: DataFrame, labels: DataFrame, n_filters: int) -> DataFrame:
    """``part, total, good, toxic``: for each part the counts of documents over all 2^n masks, as arrays.

    ``labels`` (doc_id, quality, toxic): an id counts as good or toxic if any of its rows has the value 1.
    Ids are joined by shuffle; a part has at most 2^n rows after the first aggregation, whatever its size.
    """
    one = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    named = masks.where(F.col("doc_id").isNotNull()).join(one, "doc_id", "left")
    bare = masks.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    rows = named.unionByName(bare)
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("total"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))
    at = lambda c: F.array(*(F.coalesce(F.max(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << n_filters))).alias(c)
    return cells.groupBy("part").agg(at("total"), at("good"), at("toxic"))


def incidence(names: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The columns (order, step) and, for each outcome, a matrix of (2^n masks x columns) of 0 and 1.

    ``same`` is the square matrix that adds up all columns of one filter.
    """
    n = len(names)
    columns = [("".join(order), step) for order in itertools.permutations(names) for step in range(1, n + 1)]
    bit = {x: 1 << i for i, x in enumerate(names)}
    masks = np.arange(1 << n)[:, None]
    now = np.array([bit[order[step - 1]] for order, step in columns])
    before = np.array([sum(bit[x] for x in order[: step - 1]) for order, step in columns])
    fails, earlier = (masks & now) > 0, (masks & before) > 0
    made = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": masks == now, "same": now[:, None] == now}
    return columns, {k: v.astype(np.int64) for k, v in made.items()}


def _multiplier(names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, m = incidence(names)
        orders, steps = [o for o, _ in columns], np.array([s for _, s in columns], np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = batch.num_rows
                total, good, toxic = (np.array(batch.column(i).to_pylist(), np.int64) for i in (1, 2, 3))
                removed = total @ m["removed"]
                found = (total @ m["kept"], removed, total @ m["redundant"], total @ m["unique_fails"], good @ m["removed"], toxic @ m["removed"], removed @ m["same"])
                part = [p for p in batch.column(0).to_pylist() for _ in columns]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(orders * rows), pa.array(np.tile(steps, rows)), *(pa.array(x.reshape(-1)) for x in found)], ["part", "filter_order", "step", *COUNTS])

    return run


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS) -> DataFrame:
    """One row for each part, each order of the filters and each step, zeros included, with ``COUNTS``.

    The filters are ``filters`` and ``COPY``. At a step: ``kept`` after it, ``removed`` by it, ``redundant`` (fail it, were
    removed before), ``unique_fails`` (fail no other), ``good_lost`` and ``toxic_lost`` (removed and labelled 1); ``shapley``
    is what its filter removes, added up over all orders. Null and empty texts are one text, null parts the empty
    string; repeated rows count one by one, and none of them is a copy of another with the same id. A null label is none,
    further columns aren't read, an empty table gives no rows.
    """
    names = "".join(f.name for f in filters) + COPY
    stacked = histograms(failure_masks(docs, filters), labels, len(names))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return stacked.mapInArrow(_multiplier(names), schema)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
               + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
               + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, i::INT AS step, bits[i] AS now, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before
      FROM p, range(1, 6) AS r(i)),
o AS (SELECT part, filter_order, step, now,
             coalesce(sum(n) FILTER (mask & (now | before) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (mask & now > 0 AND mask & before = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (mask & now > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (mask = now), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (mask & now > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (mask & now > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM h, s GROUP BY part, filter_order, step, now)
SELECT * EXCLUDE (now), sum(removed) OVER (PARTITION BY part, now)::BIGINT AS shapley FROM o
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": OP13_SQL}
