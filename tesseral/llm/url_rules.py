"""URL filters: host-suffix and path-prefix expressions of each url, joined on short digest prefixes with the rules' own.

A rule is a host and a path, written ``host/path``. It fits a url whose host is the rule's or a subdomain of it and whose
path starts with the rule's; of the rules that fit, the longest wins (of equally long ones the one with the longer
host; two such rules with the same text are one rule, which blocks if any of its rows does).

Every url is expanded into the suffixes of its host of as many labels as some rule's host has, times those prefixes of its path whose
length some rule's path has, so nothing that a rule can say is missed, and a long url makes no more expressions than a short one. The expressions are joined with the rules on the first eight
hex digits of their SHA-256 digests; the full digests then confirm the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.llm.work import broadcast_if_small

#: Hex digits of the digest prefix that is joined on.
PREFIX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and for urls without ://."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, _after(url)), F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _after(url: Column) -> Column:
    """What follows the first ://."""
    return F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The host's suffixes of so many labels, as far as it has them; none of an empty host."""
    have = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    some = F.filter(_longs(labels), lambda n: n <= have)
    suffixes = F.transform(some, lambda n: F.call_function("substring_index", host, F.lit("."), (-n).cast("int")))
    return F.filter(suffixes, lambda s: s != "")


def _longs(values: list[int]) -> Column:
    return F.lit(values) if values else F.array().cast("array<int>")


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row (key, host, path, rule, verdict) per row of pages.

    rules has the columns rule (text, a host, a slash and the rest of the path) and verdict (allow or block); null rules and rules without a slash fit nothing.
    Null and malformed urls have empty parts, no rule and the default verdict, as has every url that no rule fits.
    Repeated keys and rows are judged one by one. Other columns are not read. No rules: all default. An empty table gives an empty table.
    """
    named = rules.select("rule", F.upper("verdict").alias("_v")).filter(F.instr("rule", "/") > 0)
    named = named.groupBy("rule").agg(F.max(F.when(F.col("_v") == "BLOCK", "block").otherwise("allow")).alias("_block"))
    slash = F.instr("rule", "/") - 1
    named = named.select(
        F.concat(F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER), F.expr("substring(rule, instr(rule, '/'))")).alias("_rule"),
        "rule",
        slash.alias("_host_length"),
        F.col("_block").alias("_verdict"),
        F.length("rule").alias("_length"),
    )
    named = named.withColumns({"_digest": _digest(F.col("_rule")), "_short": F.substring(_digest(F.col("_rule")), 1, PREFIX)})
    # as many numbers as the longest rule has characters, at most
    lengths = [r[0] for r in named.select((F.col("_length") - F.col("_host_length")).alias("n")).distinct().orderBy("n").collect()]
    rule_host = F.substring_index("_rule", "/", 1)
    labels = [r[0] for r in named.select((F.length(rule_host) - F.length(F.replace(rule_host, F.lit("."))) + 1).alias("n")).distinct().orderBy("n").collect()]
    host, path = url_parts(F.col("_url"))
    parts = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.monotonically_increasing_id().alias("_row"))
    parts = parts.select("_row", "_key", host.alias("_host"), path.alias("_path"))
    prefixes = F.transform(F.filter(_longs(lengths), lambda n: n <= F.length("_path")), lambda n: F.substring("_path", 1, n))
    expressions = F.flatten(F.transform(host_suffixes(F.col("_host"), labels), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    each = parts.withColumn("_each", F.explode_outer(expressions)).withColumn("_d", _digest(F.col("_each")))
    each = each.withColumn("_s", F.substring("_d", 1, PREFIX))
    met = each.join(broadcast_if_small(named), (F.col("_s") == F.col("_short")) & (F.col("_d") == F.col("_digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("_length", "_host_length", "rule", "_verdict")))
    judged = met.groupBy("_row", "_key", "_host", "_path").agg(best.alias("_best"))
    return judged.select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best._verdict", F.lit(default)).alias("verdict"),
    )
