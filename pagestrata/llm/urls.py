"""URL filters: rules are indexed by their rarest literal token; the tokens of a URL fetch candidate rules, and only those
run their regular expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands in for the literal tokens of rules that have none; every URL carries it.
ANY = "*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Host labels and the path segments closed on both sides: what a rule spells out whole is whole in a URL it fits."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    segments = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ANY))))


def compiled(rules: DataFrame, rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """Rules ``host/path`` with the expression that fits a host, its subdomains and every path that goes on from theirs.
    Of equal rules with different verdicts the smallest verdict holds; null rules are left out."""
    given = rules.where(F.col(rule).isNotNull()).groupBy(F.col(rule).alias("rule")).agg(F.min(verdict).alias("verdict"))
    cut = F.locate("/", F.col("rule"))
    host = F.when(cut > 0, F.expr("substring(rule, 1, locate('/', rule) - 1)")).otherwise(F.col("rule"))
    path = F.when(cut > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit(""))
    split = given.select("rule", "verdict", F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"), path.alias("path"))
    quote = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}/])", r"\\$1")
    literal = F.array_except(F.when(F.col("host") == "", F.filter(tokens(F.col("host"), F.col("path")), lambda t: t != "h:")).otherwise(tokens(F.col("host"), F.col("path"))), F.array(F.lit(ANY)))
    at_host = F.when(F.col("host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), quote(F.col("host")), F.when(F.col("path") == "", F.lit("(?=/|$)")).otherwise(F.lit(""))))
    return split.select("rule", "verdict", F.concat(F.lit("^"), at_host, quote(F.col("path"))).alias("pattern"), F.when(F.size(literal) > 0, literal).otherwise(F.array(F.lit(ANY))).alias("literals"))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", key: str = "page_id", url: str = "url", rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """One row per page: the key, ``host``, ``path``, the longest ``rule`` that fits (null if none) and its ``verdict``, else
    ``otherwise``.

    A null URL or one without ``://`` has an empty host and path and is judged like any other. Repeated pages keep a row
    each, null keys stay, an empty table gives no rows, no rules give ``otherwise`` throughout; other columns are left
    out. How often the rules' tokens occur is counted over all sites, so the rarest token is that of these data. Sites
    (host and path) are judged once each, and candidates meet on token equality only."""
    sited = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = sited.select("host", "path").distinct().select("host", "path", F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    ready = compiled(rules, rule, verdict)
    words = ready.select("rule", F.explode("literals").alias("token"))
    often = seen.join(words.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("often"))
    best = Window.partitionBy("rule").orderBy(F.coalesce("often", F.lit(0)), F.length("token").desc(), "token")
    index = words.join(often, "token", "left").withColumn("place", F.row_number().over(best)).where("place = 1").select("rule", "token").join(ready.drop("literals"), "rule")
    fits = seen.join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    judged = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("long"), "rule", "verdict")).alias("best"))
    return sited.join(judged, ["host", "path"], "left").select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )
