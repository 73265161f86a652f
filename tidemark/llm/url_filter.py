"""Allow and block rules on hosts and path starts, matched by equi-joins.

A url is expanded into expressions: ends of its host cut at dots, times starts of its path. Only the
numbers of labels and the path lengths that occur among the rules are expanded. The first digits of an
expression's SHA-256 join it with the rules, the whole digest confirms, and the most specific rule
decides. Urls are matched once per distinct host and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8  # hex digits of the join key: 32 bits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both '' without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules`` (verdict, host, path): fits its host and all subdomains where the path starts with the rule's.
    The longest rule (host and path together) wins; of equally long ones the longer host, then ``block``, then the
    smaller string. Without a fitting rule ``rule`` is null and the verdict ``otherwise``; so too for null urls and
    urls without ``://``. Rules without host or path are left out. Other columns are ignored; no rows give no rows.
    The rules are broadcast only if Spark finds them small enough, else joined by shuffle.
    """
    pages = pages.select("page_id", *(c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))))
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).filter("r_host <> '' and r_path is not null and verdict is not null")
    sizes = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()  # bounded by the longest url
    rules = rules.select("verdict", F.concat("r_host", "r_path").alias("rule"), F.length("r_host").alias("host_length"))
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT))

    urls = pages.select("host", "path").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.filter(F.lit(sorted(sizes["labels"])) if sizes["labels"] else F.array().cast("array<int>"), lambda n: n <= F.size(labels)),
                       lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    starts = F.transform(F.filter(F.lit(sorted(sizes["lengths"])) if sizes["lengths"] else F.array().cast("array<int>"), lambda n: n <= F.length("path")),
                         lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: F.struct(F.concat(h, p).alias("text"), F.length(h).alias("host_length")))))
    tried = urls.withColumn("at", F.explode(expressions)).select("host", "path", F.sha2("at.text", 256).alias("digest"), F.col("at.host_length").alias("host_length"))
    tried = tried.withColumn("short", F.substring("digest", 1, SHORT))
    # host and path touch without a mark between them, so the split has to agree as well
    hits = tried.join(rules, ["short", "digest", "host_length"])
    rank = F.struct(F.length("rule"), "host_length", F.when(F.col("verdict") == "block", 1).otherwise(0))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("rank"), F.min(F.struct(
        -F.length("rule"), -F.col("host_length"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("order"), "rule", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
