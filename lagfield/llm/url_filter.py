"""Block and allow rules on URLs: expand, join on short hash prefixes, confirm full digests, apply precedence.

A URL becomes expressions ``host-suffix + path-prefix``; only suffixes of as many labels and prefixes of as many
characters as some rule has are made, so that their number is bounded by the rules and not by the URL. The
expressions meet the rules in an equi-join on the first 32 bits of a SHA-256; the full digest then has to agree, and the
longest rule wins (then the one with the longer host, then block before allow).

Defined results: a null URL or one without ``://`` has an empty host and path and matches nothing; empty path
matches only rules with an empty path; repeated rows each get their row; an empty table gives an empty
result; a URL that no rule fits is allowed; URLs of any length pass whole; columns beside id and URL are not read, whatever their names. The rule table is broadcast only when it holds at most ``BROADCAST_RULES`` rows (counted);
above that the join is a shuffled one, whose skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read

BROADCAST_RULES = 50_000
DEFAULT_VERDICT = "allow"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.encode(F.concat(host, F.lit("\n"), path), "utf-8"), 256)


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``rules``: verdict, host, path. One row per row of ``urls``: id, host, path, rule, verdict."""
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct()
    shape = rules.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    n_rules, labels, lengths = shape[0], sorted(shape[1]) or [0], sorted(shape[2]) or [0]
    known = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.struct(F.length(F.concat("host", "path")).alias("whole"), F.length("host").alias("host_part"), (F.col("verdict") == "block").alias("blocks")).alias("rank"),
    ).withColumn("rule_prefix", F.substring("rule_digest", 1, 8))
    if n_rules <= BROADCAST_RULES:
        known = F.broadcast(known)
    pages = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    pages = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spread = pages.withColumn("suffix", F.explode_outer(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
    spread = spread.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, 8))
    hits = spread.join(known, (F.col("short") == F.col("rule_prefix")) & (F.col("digest") == F.col("rule_digest")), "left")
    best = hits.groupBy("page_id", "url").agg(
        F.first("copies").alias("copies"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max(F.when(F.col("rule").isNotNull(), F.struct("rank", "rule", "rule_verdict"))).alias("best"),
    )
    out = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(DEFAULT_VERDICT)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in RULES]))
    return filter_urls(read(spark, sf_dir, "pages"), spark.range(1).select(rules))


SQL = {
    "op9_url_filter": r"""
WITH u AS (SELECT page_id, strpos(coalesce(url, ''), '://') > 0 AS has, substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3) AS rest FROM pages),
s AS (SELECT page_id, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
f AS (SELECT *, (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS r1,
  (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS r2,
  (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS r3,
  (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS r4 FROM s)
SELECT page_id, host, path, CASE WHEN r3 THEN 'example.com/de/' WHEN r2 THEN 'example.net/en/' WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
  CASE WHEN r3 THEN 'block' WHEN r2 THEN 'allow' WHEN r4 THEN 'allow' WHEN r1 THEN 'block' ELSE 'allow' END AS verdict FROM f"""
}
