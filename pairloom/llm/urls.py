"""URL rules by hashed expressions: host suffixes times path stems, joined on digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hex digits of the digest that the join compares

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty for null and where ``://`` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _count(x: Column, mark: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))


def _digest(host: Column, stem: Column) -> Column:
    return F.sha2(F.concat(host, stem), 256)


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the
    path starts with the rule's. The longest rule (host and path) wins, then the longer host,
    then block over allow. Without a fitting rule the rule is null and the verdict is
    ``default``. Repeated rows stay, null and malformed URLs have empty host and path. A rule
    without host fits nothing, one without path every path. Only id and URL are read.

    A URL's expressions are its last labels (as many as the longest rule host has) times its
    path up to each slash (as many as the deepest rule has), so none is lost and a long URL
    costs no more than a short one. Distinct (host, path) are expanded once, however many
    rows share them.
    """
    stem = F.concat_ws("/", F.slice(F.split("rule_path", "/"), 1, _count(F.col("rule_path"), "/")), F.lit(""))
    rules = rules.where(F.col("host") != "").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"), "verdict",
    ).select("*", F.when(F.contains("rule_path", F.lit("/")), stem).otherwise("").alias("stem")).select(
        "*", _digest(F.col("rule_host"), F.col("stem")).alias("rule_digest"),
        F.concat("rule_host", "rule_path").alias("rule"),
    ).distinct()
    widest, deepest = rules.agg(
        F.coalesce(F.max(_count(F.col("rule_host"), ".") + 1), F.lit(0)),
        F.coalesce(F.max(_count(F.col("stem"), "/")), F.lit(0)),
    ).first()
    host, path = host_and_path(F.col(url_col))
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.least(_count(F.col("host"), ".") + 1, F.lit(max(widest, 1)))
    slashes = F.least(_count(F.col("path"), "/"), F.lit(deepest))
    suffix = F.expr("substring_index(host, '.', -labels)")
    stems = F.expr("CASE WHEN slashes = 0 THEN '' ELSE substring_index(path, '/', slashes) || '/' END")
    expressions = (
        seen.select("host", "path").distinct()
        .select("*", F.explode(F.sequence(F.lit(1), labels)).alias("labels"))
        .select("*", F.explode(F.sequence(F.lit(0), slashes)).alias("slashes"))
        .select("host", "path", _digest(suffix, stems).alias("digest"))
    )
    fits = expressions.join(
        rules,
        (F.left("digest", F.lit(PREFIX)) == F.left("rule_digest", F.lit(PREFIX)))
        & (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"),
    )
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict") == "block", "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
