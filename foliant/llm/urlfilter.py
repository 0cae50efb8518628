"""URL filters: rule lists judged by hash-prefix lookups.

A rule is (verdict, host, path).  It fits a URL whose host is the rule's host
or a subdomain of it and whose path starts with the rule's path.  Each URL is
expanded into host suffixes x path prefixes, only of shapes (number of labels,
path length) that some rule has, so a URL gives as many keys as there are
shapes and never more.  Keys meet the rules by a short hash prefix; the full
SHA-256 then confirms, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path) of the production list.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw_host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw_host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return ascii_lower(raw_host), path


def _digest(host: Column, path: Column) -> Column:
    # With the host's length in front, no other pair gives the same string.
    return F.sha2(F.concat_ws(" ", F.length(host).cast("string"), host, path), 256)


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    rows = [(v, h, p) for v, h, p in rules]
    df = spark.createDataFrame(rows, "r_verdict string, r_host string, r_path string")
    return df.select(
        "r_verdict",
        F.concat("r_host", "r_path").alias("r_rule"),
        (F.length("r_host") + F.length("r_path")).alias("r_length"),
        F.regexp_count("r_host", F.lit(r"\.")).alias("r_dots"),
        F.length("r_path").alias("r_path_length"),
        _digest(F.col("r_host"), F.col("r_path")).alias("r_digest"),
    ).withColumn("r_prefix", F.substring("r_digest", 1, 8))


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Iterable[tuple[str, str, str]] = RULES,
    default: str = "allow",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    Null URLs and URLs without ``://`` have empty host and path, fit no rule
    and get ``default``, like all URLs that no rule fits.  Repeated rows stay
    and get the same verdict; an empty table gives an empty result.  If two
    rules of one length fit, blocking wins.  Input columns named like the
    four added ones are replaced.

    Plan: distinct URLs (pre-aggregated, so a hot URL is one key), the rule
    join, one max per URL, then the rows look their URL up by an outer join
    whose larger side AQE can split.  Spark broadcasts the rules only while
    their known size is below its threshold; else both sides are hashed on
    the digest prefix.
    """
    spark = pages.sparkSession
    rules = list(rules)
    table = rule_table(spark, rules)
    shapes = sorted({(h.count("."), len(p)) for _, h, p in rules})
    distinct = pages.select(F.col(url).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    host, path = url_parts(F.col("__url"))
    parts = distinct.select("__url", host.alias("__host"), path.alias("__path"))
    dots = F.length("__host") - F.length(F.replace(F.col("__host"), F.lit("."), F.lit("")))
    keys = []
    for d, n in shapes:
        fits = (dots >= d) & (F.length("__path") >= n) & (F.length("__host") > 0)
        suffix = F.substring_index(F.col("__host"), ".", -(d + 1))
        prefix = F.substring(F.col("__path"), 1, n) if n else F.lit("")
        keys.append(F.when(fits, _digest(suffix, prefix)))
    expanded = parts.select("__url", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *keys))).alias("__digest"))
    hits = expanded.withColumn("__prefix", F.substring("__digest", 1, 8)).join(
        table, (F.col("__prefix") == F.col("r_prefix")) & (F.col("__digest") == F.col("r_digest"))
    )
    best = hits.groupBy("__url").agg(F.max(F.struct("r_length", (F.col("r_verdict") == "block").alias("b"), "r_rule", "r_verdict")).alias("__best"))
    best = best.select(F.col("__url").alias("__key"), F.col("__best.r_rule").alias("__rule"), F.col("__best.r_verdict").alias("__verdict"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, F.col(url).alias("__url"))
    host, path = url_parts(F.col("__url"))
    return rows.join(best, F.col("__url") == F.col("__key"), "left").select(
        *kept,
        host.alias("host"),
        path.alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce(F.col("__verdict"), F.lit(default)).alias("verdict"),
    )
