"""Rule ledger: every rule is evaluated once and its failure kept as one bit beside the measurements.

Policies are versioned bit masks over the ledger, so a policy change, or an ablation of every rule,
is a bitwise aggregation over the stored ledger and never a second pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import WORD, materialize, release, small_batches, table, text_hashes, without_texts

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``failed`` is true; bits never change their meaning."""

    bit: int
    name: str
    failed: Callable[[], Column]


#: Bits 0 and 1 are the base rules; counts are compared as integers, so both engines agree exactly.
RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "symbols", lambda: 100 * F.col("n_symbols") > 25 * F.col("n_words")),
    Rule(3, "repeated_lines", lambda: (F.col("n_dup_lines") > 2) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
    Rule(4, "upper_case", lambda: (F.col("n_letters") > 0) & (100 * F.col("n_upper") > 40 * F.col("n_letters"))),
    Rule(5, "long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule(6, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
)
BASE_MASK = 0b11
#: Versioned policies: the bits that reject a document.
POLICIES = {"v1": 0b11, "v2": 0b0011111, "v3": 0b1111111}
PRODUCTION = "v3"


def measure_text(text: str | None) -> tuple[int, ...]:
    """The ``MEASURES`` of one text; a null text counts as an empty one."""
    if not text:
        return (0,) * len(MEASURES)
    found = WORD.findall(text)
    n = len(found)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = 0
    if n > WINDOW:
        ids = np.fromiter(map(hash, found), np.int64, n).view(np.uint64)
        m = n - WINDOW + 1
        grams = np.zeros(m, np.uint64)
        for i in range(WINDOW):
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + m]
        order = np.argsort(grams)
        grams = grams[order]
        same = grams[1:] == grams[:-1]
        if same.any():
            twice = np.zeros(m, bool)
            twice[1:] |= same
            twice[:-1] |= same
            edges = np.zeros(n + 1, np.int32)
            at = order[twice]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + WINDOW, -1)
            repeat = int((np.cumsum(edges[:-1]) > 0).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    return (
        n,
        sum(map(len, found)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        upper,
        upper + lower,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "h1", "h2", *MEASURES]
    for batch in batches:
        rows = [measure_text(x.as_py()) for x in batch.column(1)]
        columns = zip(*rows, strict=True) if rows else ([] for _ in MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, pa.int64()) for c in columns)], names)
    release()


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.failed(), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, two hashes of the text, the measurements and ``failed_bits``.

    Only the id and the text are read, so extra or clashing columns don't matter. Null and empty
    texts have zero measurements and fail ``few_words``; repeated ids keep one row each; an empty
    table gives an empty ledger. Texts are read whole, one at a time; no shuffle takes place.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    kind = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *text_hashes(text))
    schema = f"doc_id {kind.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, " + ", ".join(f"{m} long" for m in MEASURES)
    return kind.mapInArrow(_measure, schema).withColumn("failed_bits", failure_bits())


def apply_policy(ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Adds ``kept``: no failed bit lies in the policy's mask."""
    return ledger.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rule_ledger`` written to the shared folder: a row of ten numbers a document, which all policies and ablations read."""
    return materialize(rule_ledger(docs, id_col, text_col), "ledger")


def keep_by_ledger(docs: DataFrame, ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` whose text the policy keeps, by a ledger of these rows.

    Rows are told by id and text hashes; a null id is one like others. Rejected rows are few, so
    they are broadcast up to a size and the texts aren't shuffled.
    """
    return without_texts(docs, apply_policy(ledger, policy).where("not kept"))


def ablation(ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and the kept count without it.

    The ledger is first reduced to one count per distinct bit pattern (at most 2^rules rows).
    """
    mask = POLICIES[policy]
    spark = ledger.sparkSession
    rules = spark.createDataFrame([(r.bit, r.name, 1 << r.bit) for r in RULES if mask >> r.bit & 1], "bit int, rule string, flag long")
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask))
    patterns = ledger.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    per = patterns.join(F.broadcast(rules), F.lit(True))  # 2^rules patterns by a handful of rules
    has = F.col("hit").bitwiseAND(F.col("flag")) != 0
    rest = F.col("hit").bitwiseAND(F.bitwise_not(F.col("flag"))) == 0
    zero = F.lit(0).cast("long")
    return per.groupBy("bit", "rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(has & rest, F.col("n")).otherwise(zero)).alias("n_failed_alone"),
        F.sum(F.when(rest, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy does, from the ledger alone."""
    return ablation(stored_ledger(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(table(spark, sf_dir, "documents"))
    return apply_policy(ledger).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"),
        "kept",
        "failed_bits",
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p,
         unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS w FROM d WHERE len(ws) > 4),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM c WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_letters > 0 AND 100 * n_upper > 40 * n_letters THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
"""
OP9_ROWS = "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b"
OP9_RULES = (
    ", v(bit, rule) AS (VALUES " + ", ".join(f"({r.bit}::INT, '{r.name}')" for r in RULES) + ") SELECT bit, rule, count(*) FILTER (failed_bits & (1 << bit) <> 0) AS n_failed, "
    "count(*) FILTER (failed_bits = (1 << bit)) AS n_failed_alone, count(*) FILTER (failed_bits & ~(1::BIGINT << bit) = 0) AS n_kept_without FROM b, v GROUP BY bit, rule"
)

QUERIES = {"op9_quality_rules": op9_quality_rules, "rule_ablation": rule_ablation}
ORACLES = {"op9_quality_rules": OP9_SQL + OP9_ROWS, "rule_ablation": OP9_SQL.rstrip() + OP9_RULES}
