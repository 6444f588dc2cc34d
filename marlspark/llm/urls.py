"""URL filters: a blocked Bloom filter in front of an exact hash join.

A listing has rows (host, path, verdict, is_rule). An entry fits its host and all subdomains if the
url's path starts with the entry's; one with an empty path fits any. A url is looked up under all its host suffixes and the path lengths
that occur in the listing. The Bloom filter lets possible hits through, a few per cent of the keys;
the hash join on the whole key removes its false positives. Rules go before plain listed entries, then
the longest wins. Each distinct (host, path) is judged once and the verdicts are joined back.

The filter has at most `MAX_BLOCKS` blocks of 512 bits, so what is sent to the tasks is bounded however
long the listing is; a fuller filter passes more keys, and the join still decides.

Defined results: a null url or one without `://` has empty host and path, fits nothing and is allowed;
repeated rows are judged each; ties of length go to the rule's text, smallest first; an empty table
gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.llm.common import lower_ascii, small_table

WORDS = 8
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 20
BROADCAST_ROWS = 100_000

#: The rules, then the hosts listed as spam, all of whose pages are blocked.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LISTED = ("casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def default_listing(spark: SparkSession) -> DataFrame:
    rows = [{"host": h, "path": p, "verdict": v, "is_rule": True} for v, h, p in RULES] + [{"host": h, "path": "", "verdict": "block", "is_rule": False} for h in LISTED]
    return small_table(spark, rows, "host string, path string, verdict string, is_rule boolean")


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def bloom_blocks(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter's words, shape (blocks, 8), of the column `key`; built by the tasks, at most 8 rows a block reach the driver."""
    h, g = _hashes(F.col("key"))
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * k}) & 63 as int))")
    hashed = keys.select(h.alias("h"), F.pmod(g, F.lit(blocks)).alias("block"))
    found = hashed.groupBy("block").agg(*[F.bit_or(bit(k)).alias(f"w{k}") for k in range(WORDS)]).collect()
    out = np.zeros((blocks, WORDS), dtype=np.int64)
    for row in found:
        out[row["block"]] = [row[f"w{k}"] for k in range(WORDS)]
    return out.view(np.uint64)


def judge(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """`pages` (page_id, url) with host, path, rule and verdict."""
    spark = pages.sparkSession
    entries = listing.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict", "is_rule")
    size = entries.count()
    lengths = sorted(r["n"] for r in entries.select("n").distinct().collect())
    blocks = min(MAX_BLOCKS, 1 << max(0, (size * BITS_PER_KEY // (64 * WORDS)).bit_length()))
    table = spark.sparkContext.broadcast(bloom_blocks(entries.select("key"), blocks))

    @F.pandas_udf("boolean")
    def maybe_listed(h: pd.Series, g: pd.Series) -> pd.Series:
        words = table.value
        block = words[np.mod(g.to_numpy(), len(words))]
        bits = h.to_numpy().view(np.uint64)
        hit = np.ones(len(bits), dtype=bool)
        for k in range(WORDS):
            hit &= (block[:, k] >> ((bits >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(hit)

    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda n: F.concat(s, F.substr(F.col("path"), F.lit(1), n)))))
    candidates = distinct.where(F.length("host") > 0).select("host", "path", F.explode(keys).alias("key"))
    h, g = _hashes(F.col("key"))
    possible = candidates.where(maybe_listed(h, g))
    exact = entries.drop("n")
    hits = possible.join(F.broadcast(exact) if size <= BROADCAST_ROWS else exact, "key")
    order = F.struct(F.col("is_rule").cast("int").alias("r"), F.length("key").alias("n"), F.col("key").alias("k"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict", "is_rule"), order).alias("hit"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "url", "host", "path", F.when(F.col("hit.is_rule"), F.col("hit.key")).alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict")
    )


def url_report(pages: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """The verdicts by `listing`, or by the fixed values."""
    return judge(pages, default_listing(pages.sparkSession) if listing is None else listing).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS s FROM pages),
a AS (SELECT page_id, CASE WHEN s = 0 THEN '' ELSE substr(url, s + 3) END AS rest FROM u),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(h, q, verdict, is_rule) AS (VALUES ('org', '/', 'allow', 1), ('example.org', '/es/', 'block', 1), ('example.org', '/en/1', 'block', 1),
    ('com', '/fr/', 'allow', 1), ('com', '/de/', 'block', 1), ('casino-win.example.com', '/', 'block', 0), ('free-bets.example.com', '/', 'block', 0),
    ('cheap-pills.example.com', '/', 'block', 0), ('ads-track.example.com', '/', 'block', 0)),
m AS (SELECT p.*, h || q AS rule, verdict, is_rule,
             row_number() OVER (PARTITION BY page_id ORDER BY is_rule DESC NULLS LAST, length(h || q) DESC, h || q DESC) AS k
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, CASE WHEN is_rule = 1 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
