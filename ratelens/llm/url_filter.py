"""URL filter: a blocked Bloom filter of the listed canonical URLs before an exact hash join.

The filter is a table of 256-bit blocks (eight 32-bit words), built by a bitwise aggregation and
probed by a join on the block number, so it is never gathered on the driver and grows with the list.
What passes meets the exact list in a hash join, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, split_join, table

WORDS, KEYS_PER_BLOCK = 8, 12
#: A list of at most this many bytes is broadcast.
BROADCAST_LIST = 16_000_000
#: A filter of at most this many blocks (about 100 bytes each) is broadcast, a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 65_536
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str


RULES = (
    UrlRule("com", "/en/", "block"),
    UrlRule("example.com", "/en/7", "allow"),
    UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"),
    UrlRule("org", "/es/", "block"),
)


def parse_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and canonical form; host and path are empty without ``://`` or a url.

    Canonical: host without leading ``www.`` or a default port, path without a trailing slash, query
    kept, scheme and fragment dropped; null where there is no host.
    """
    empty = F.lit("")
    host = F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), empty)
    path = F.coalesce(F.regexp_extract(url, URL, 2), empty)
    query = F.coalesce(F.regexp_extract(url, QUERY, 1), empty)
    bare = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    canonical = F.when(host != "", F.concat(bare, F.regexp_replace(path, "/$", ""), query))
    return host, path, canonical


def match_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits. For lists of policy size."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _bit(word: int, of: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(of, 5 * word).bitwiseAND(F.lit(31)).cast("int"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: ``block, w0 .. w7``; blocks without a key are absent."""
    marks = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), F.xxhash64(F.lit(17), "canonical").alias("mark"))
    return marks.groupBy("block").agg(*(F.bit_or(_bit(i, F.col("mark"))).alias(f"w{i}") for i in range(WORDS)))


def listed_flag(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``urls`` (with a ``canonical`` column) plus ``is_listed``; each row stays exactly once.

    The list is written once, with its size. A list of at most ``BROADCAST_LIST`` URLs is broadcast: filter and
    exact join are then one pass over ``urls`` without a shuffle. A larger one is joined by a shuffle, in which
    rows that the filter rules out, and rows without a URL, take no part.
    """
    listed = materialize(listed.where(F.col("canonical").isNotNull()).select("canonical").distinct(), "listed")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("canonical")), F.lit(0))).first()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    bloom = bloom_blocks(listed, blocks)
    block = F.when(F.col("canonical").isNotNull(), F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
    probe = urls.withColumns({"block": block, "mark": F.xxhash64(F.lit(17), "canonical")})
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(i, F.col("mark"))) != 0)
    small = size + 16 * n <= BROADCAST_LIST
    if small:
        probe = probe.join(F.broadcast(bloom), "block", "left")
    else:  # the filter is a tenth of the list; blocks are even, as they are hashed
        probe = probe.join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, "block", "left")
    probe = probe.select(*urls.columns, F.when(F.coalesce(hit, F.lit(False)), F.col("canonical")).alias("possible"))
    exact = listed.select(F.col("canonical").alias("possible"), F.lit(True).alias("is_listed"))
    if small:
        joined = probe.join(F.broadcast(exact), "possible", "left")
    else:
        probe = materialize(probe, "probe")
        some = probe.where(F.col("possible").isNotNull())
        joined = split_join(some, exact, ["possible"], some.count(), "left").unionByName(probe.where(F.col("possible").isNull()).withColumn("is_listed", F.lit(False)))
    return joined.select(*urls.columns, F.coalesce("is_listed", F.lit(False)).alias("is_listed"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, is_listed`` for every row of ``pages``.

    ``listed`` has a ``canonical`` column of blocked URLs. The longest fitting rule decides; without
    one, a listed URL is blocked and any other allowed. Null or malformed urls have an empty host and
    path and are allowed. Repeated ids and urls keep one row each; either table may be empty. Urls of any length
    are parsed whole; other columns are ignored.
    """
    host, path, canonical = parse_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), canonical.alias("canonical"))
    judged = listed_flag(parsed, listed)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("is_listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "is_listed")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of all pages whose id is divisible by 20."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("page_id") % 20 == 0).select(parse_url(F.col("url"))[2].alias("canonical"))
    return filter_urls(pages, listed)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/$', '') || query END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE page_id % 20 = 0 AND canonical IS NOT NULL),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
b AS (
  SELECT page_id, host, path, canonical,
    (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule FROM c)
SELECT b.page_id, b.host, b.path, b.rule,
  coalesce((SELECT rverdict FROM r WHERE rhost || rpath = b.rule), CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canonical IS NOT NULL AS is_listed
FROM b LEFT JOIN l ON b.canonical = l.canonical
"""

QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": OP6_SQL}
