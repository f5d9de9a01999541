"""A language detector: frequent character trigrams of labelled texts.

A trigram is a number of 63 bits, 21 for each character, so that tasks count and look up those of a text as arrays: no row
is made for a trigram of a text, and nothing but counts by language is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT, NONE = "undetected_short", "und"
#: Characters whose trigrams are held at once; longer texts are read in pieces, short ones are counted together.
PIECE = 1 << 20


def _codes(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text, at most ``PIECE`` at once."""
    for at in range(0, len(text) - 2, PIECE):
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le"), np.uint32).astype(np.int64)
        yield c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _code(gram: str) -> int:
    return int(next(_codes(gram))[0])


def _lowered(text: str) -> Column:
    """The lower-cased text, whose runs of three characters, blanks included, are its trigrams; null under three."""
    return F.when(F.length(text) >= 3, F.lower(text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(*(batch.column(i) for i in range(2)), strict=True):
            for codes in _codes(text.as_py()):
                held.setdefault(lang.as_py(), []).append(codes)
                size += len(codes)
                if size >= PIECE:
                    yield from (told(*x) for x in held.items())
                    held, size = {}, 0
    yield from (told(*x) for x in held.items())


def fit(df: DataFrame, text: str = "review_text", label: str = "detected_lang", most: int = 400) -> DataFrame:
    """``gram, lang, weight``: smoothed log shares of each language's ``most`` frequent trigrams in all languages.

    Counts cover all rows that have a label; they are summed map-side, and the model has at most ``most`` trigrams
    by language squared, whatever the number of rows.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("lang"), _lowered(text).alias("text")).where("text is not null")
    summed = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    part = lambda shift: F.decode(F.unhex(F.lpad(F.hex(F.shiftright("code", shift).bitwiseAND(F.lit(2**21 - 1))), 8, "0")), "UTF-32")
    counts = summed.select("lang", F.concat(part(42), part(21), part(0)).alias("gram"), "n")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("nth", nth).where(F.col("nth") <= most).select("gram").distinct()
    grid = kept.join(F.broadcast(totals), F.lit(True))  # the bounded list of trigrams by a row a language
    size = F.count("*").over(Window.partitionBy("lang"))
    known = grid.join(counts, ["lang", "gram"], "left")
    return known.select("gram", "lang", F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("total") + size)).alias("weight"))


def _scorer(grams: np.ndarray, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(text: str | None) -> list[float] | None:
        n = np.zeros(len(grams), np.int64)
        for codes in _codes(text or ""):
            at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            n += np.bincount(at[grams[at] == codes], minlength=len(grams))
        return (n @ weights).tolist() if n.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["key", "short", "scores"])

    return run


def detect(df: DataFrame, model: DataFrame, text: str = "review_text", key: str = "review_id") -> DataFrame:
    """``key, lang_pred``: the language whose weights of the text's trigrams sum highest (the first of equal ones).

    Texts under three characters (trimmed; null ones too) are marked ``undetected_short``, others without any known trigram
    ``und``. The model, which is bounded, goes to all tasks; rows are scored where they are.
    """
    found = {(r["gram"], r["lang"]): r["weight"] for r in model.collect()}  # bounded, whatever the number of rows
    grams, langs = sorted({g for g, _ in found}, key=_code), sorted({lang for _, lang in found})
    short = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 3
    rows = df.select(F.col(key).alias("key"), short.alias("short"), F.when(~short, _lowered(text)).alias("text"))
    best = F.lit(None).cast("string")
    if grams:
        weights = np.array([[found[g, lang] for lang in langs] for g in grams])
        rows = rows.mapInArrow(_scorer(np.array([_code(g) for g in grams]), weights), f"key {df.schema[key].dataType.simpleString()}, short boolean, scores array<double>")
        ranked = [F.struct((-F.round(F.col("scores")[i], 6)).alias("s"), F.lit(lang).alias("lang")) for i, lang in enumerate(langs)]
        best = F.when(F.col("scores").isNotNull(), F.array_min(F.array(*ranked))["lang"])
    return rows.select(F.col("key").alias(key), F.when(F.col("short"), SHORT).otherwise(F.coalesce(best, F.lit(NONE))).alias("lang_pred"))
