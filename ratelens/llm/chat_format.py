"""Chat formatting: collapse cumulative snapshots of logged conversations, then render what is left.

A log that stores a conversation after every turn holds each conversation many times, as prefixes of
the longest one. Rolling turn-prefix hashes find these by equality, so no texts are compared and no
pairs are made: 128 bits, the XOR of position-tagged turn hashes, computed by one running window.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, split_join, table

SEEDS = (7, 1_000_003)
KEY = ("pos", "p1", "p2")


def _turn_hash(seed: int) -> Column:
    parts = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.xxhash64(F.lit(seed), F.col("pos"), *parts)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, p1, p2, last`` for every turn; p1 and p2 identify the first ``pos`` turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("pos"), F.lead(F.lit(1)).over(order).isNull().alias("last")
    )
    hashed = numbered.select("conv_id", "turn", "role", "text", "pos", "last", _turn_hash(SEEDS[0]).alias("h1"), _turn_hash(SEEDS[1]).alias("h2"))
    return hashed.select("conv_id", "pos", "last", F.bit_xor("h1").over(running).alias("p1"), F.bit_xor("h2").over(running).alias("p2"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, collapsed_into, kept``.

    A conversation is kept if it isn't a proper prefix of another one, and has the smallest id of its
    exact copies; ``collapsed_into`` is the smallest kept conversation that starts with its turns
    (itself if kept). Turns are ordered by turn, then role and text, nulls first; repeated rows are
    turns of their own; null roles and texts equal only nulls. Rows without a conv_id belong to no
    conversation and are left out. An empty table gives no rows. Other columns are ignored. Texts of any length are hashed
    where they are; the turns of one conversation are sorted in one task.
    """
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    prefixes = materialize(prefix_hashes(rows), "prefixes")
    whole = prefixes.where("last").select("conv_id", *KEY)
    # Partial aggregation leaves one row per key and task, however many copies a key has.
    firsts = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where(~F.col("last")).groupBy(*KEY).agg(F.lit(1).alias("seen")).select(*KEY)
    maximal = materialize(firsts.join(proper, list(KEY), "left_anti").select("conv_id"), "maximal")
    owners = prefixes.join(maximal, "conv_id", "left_semi").groupBy(*KEY).agg(F.min("conv_id").alias("collapsed_into"))
    joined = split_join(whole, materialize(owners, "owners"), list(KEY), whole.count())
    return joined.select("conv_id", F.col("pos").alias("n_turns"), "collapsed_into", (F.col("conv_id") == F.col("collapsed_into")).alias("kept"))


def bare(value: Column, missing: str) -> Column:
    """A role or text whose markers are broken up by a space, so that it can't begin or end a turn."""
    return F.replace(F.coalesce(value, F.lit(missing)), F.lit("<|im_"), F.lit("<| im_"))


def rendered(turn: Column) -> Column:
    """One turn in chat markup; a role is one line, its line breaks become blanks."""
    role = F.regexp_replace(bare(turn["role"], "unknown"), "[\r\n]+", " ")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), bare(turn["text"], ""), F.lit("<|im_end|>\n"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """``conv_id, rendered`` for the conversations in ``kept``; one training example is one row, whatever its length."""
    own = turns.join(kept.select("conv_id"), "conv_id", "left_semi")
    turn = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    gathered = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.array_join(F.transform("turns", rendered), "").alias("rendered"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    classes = materialize(collapse_snapshots(turns), "classes")
    texts = render(turns, classes.where("kept"))
    return classes.join(texts, "conv_id", "left")


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
e AS (
  SELECT conv_id, count(*)::BIGINT AS n,
    string_agg(coalesce(length(role)::VARCHAR, 'n') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, 'n') || ':' || coalesce(text, '') || ';', '' ORDER BY pos) AS s,
    string_agg('<|im_start|>' || regexp_replace(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), '[\r\n]+', ' ', 'g') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS r
  FROM t GROUP BY conv_id),
f AS (SELECT n, s, min(conv_id) AS conv_id FROM e GROUP BY n, s),
m AS (SELECT conv_id, s FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.n > a.n AND starts_with(b.s, a.s))),
o AS (SELECT e.conv_id, min(m.conv_id) AS collapsed_into FROM e JOIN m ON starts_with(m.s, e.s) GROUP BY e.conv_id)
SELECT e.conv_id, e.n AS n_turns, o.collapsed_into, e.conv_id = o.collapsed_into AS kept,
  CASE WHEN e.conv_id = o.collapsed_into THEN e.r END AS rendered FROM e JOIN o ON e.conv_id = o.conv_id
"""

QUERIES = {"op1_chat_formatting": op1_chat_formatting}
ORACLES = {"op1_chat_formatting": OP1_SQL}
