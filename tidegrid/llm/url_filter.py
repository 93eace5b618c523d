"""URL rules by host suffix and path prefix: short hash join, full digest check, precedence.

Every URL is expanded into the (host suffix, path prefix) expressions that a rule could have. Expressions meet
the rules in an equi-join on the first bytes of their digest; the full digest then confirms the match and the
longest rule decides.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; an empty path fits only
rules with an empty path; of rules equal in host and path, a blocking one decides; repeated URLs are judged once and each
row gets its verdict. Other columns of the table stay behind unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # a host has no slash, so the first one separates the parts of a rule whose path begins with it
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _ends(path: Column) -> Column:
    """Lengths of the path prefixes that end with a slash."""
    return F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.lit(1)) == "/")


def expressions(host: Column, path: Column, labels: int, longest: int, other_lengths: list[int]) -> Column:
    """(host suffix, path prefix) pairs that some rule may equal.

    ``labels``: most labels of a rule's host. ``longest``: longest path of a rule. ``other_lengths``: lengths of rule paths
    that don't end with a slash. Longer expressions equal no rule, so nothing is lost.
    """
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))),
        lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."),
    )
    head = F.substring(path, 1, longest)
    lengths = F.when(F.length(head) > 0, _ends(head)).otherwise(F.array().cast("array<int>"))
    if other_lengths:
        given = F.filter(F.array(*map(F.lit, other_lengths)), lambda i: i <= F.length(path))
        lengths = F.array_union(lengths, given)
    prefixes = F.transform(lengths, lambda i: F.substring(path, F.lit(1), i))
    return F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"))))
    )


def judge(
    pages: DataFrame, rules: DataFrame, keep: list[str], url_col: str = "url", default: str = "allow", prefix: int = 8
) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row.

    ``rules``: host, path, verdict. ``prefix``: hexadecimal digits of the digest in the join key. The join carries no
    hint: Spark broadcasts the rules only while their size is below its own limit.
    """
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    ends = F.col("r_path").endswith("/")
    bounds = rules.agg(
        F.max(F.size(F.split("r_host", r"\.", -1))).alias("labels"),
        F.max(F.length("r_path")).alias("longest"),
        F.sort_array(F.collect_set(F.when(~ends, F.length("r_path")))).alias("other"),
    ).first()
    digest = _digest(F.col("r_host"), F.col("r_path"))
    known = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).select(
        F.substring(digest, 1, prefix).alias("r_key"),
        digest.alias("r_digest"),
        F.concat("r_host", "r_path").alias("r_rule"),
        "r_verdict",
    )
    host, path = split_url(F.col(url_col))
    rows = pages.select(*keep, host.alias("u_host"), path.alias("u_path"))
    urls = rows.select("u_host", "u_path").distinct()
    asked = urls.select(
        "u_host", "u_path",
        F.explode(expressions(F.col("u_host"), F.col("u_path"), bounds.labels or 1, max(bounds.longest or 0, 1), bounds.other or [])).alias("e"),
    ).select("u_host", "u_path", _digest(F.col("e.h"), F.col("e.p")).alias("u_digest"))
    best = (
        asked.withColumn("r_key", F.substring("u_digest", 1, prefix))
        .join(known, "r_key")
        .where(F.col("u_digest") == F.col("r_digest"))
        .groupBy("u_host", "u_path")
        .agg(F.max(F.struct(F.length("r_rule").alias("n"), "r_verdict", "r_rule")).alias("best"))
    )
    return rows.join(best, ["u_host", "u_path"], "left").select(
        *keep,
        F.col("u_host").alias("host"),
        F.col("u_path").alias("path"),
        F.col("best.r_rule").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )
