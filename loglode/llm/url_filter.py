"""Allow and block rules on hosts and paths, as a sort-merge join of intervals of canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.llm.common import stored

URLS_PER_RANGE = 1_000_000
MIN_RANGES = 16
SAMPLES_PER_RANGE = 100
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z in lower case; '' without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def reversed_host(host: Column) -> Column:
    """'www.example.net' as 'net.example.www.': a host and all its subdomains share this prefix and no other host has it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_chains(rules: DataFrame) -> DataFrame:
    """(key, chain): the canonical key of every rule and all rules whose key is a prefix of it, shortest first.

    This is the stack of nested rules that a sweep over sorted keys holds once it has met this rule.
    """
    rule = F.concat("host", "path")
    made = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.concat(reversed_host(F.col("host")), F.col("path")).alias("key"), rule.alias("rule"), F.col("verdict"))
    made = made.groupBy("key").agg(F.min(F.struct("rule", "verdict")).alias("r")).select("key", "r.rule", "r.verdict")
    prefixes = made.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    outer = made.select(F.col("key").alias("prefix"), F.struct(F.length("key").alias("n"), F.col("key").alias("prefix"), "rule", "verdict").alias("r"))
    return prefixes.join(outer, "prefix").groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("chain"))


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, ...) under rules (host, path, verdict).

    A rule fits its host and all subdomains if the path starts with the rule's. The rule with the longest text (host and
    path together) wins, of equal ones the last in order of text; without one the verdict is DEFAULT_VERDICT.

    Keys are reversed hosts followed by paths, so every rule is an interval of keys. Each distinct host and path asks
    once under each of its domains (at most as many as the longest rule has labels). Splitters from a sample cut the
    keys into ranges; a rule goes to every range its interval meets; within a range, sorted by key, the last rule before
    a url carries the stack of rules open there, of which those that end before the url are dropped. A url that very
    many rows share is judged once, rows meet their verdict in a join that splits skewed keys.

    Defined cases: a null url, or one without ://, has empty host and path and no rule; null rules are ignored, of rules
    with equal host and path the first verdict in order of text counts; without rules all get the default; repeated
    rows are judged alike; other columns are ignored.
    """
    url = F.coalesce(F.col("`url`"), F.lit(""))
    asked = pages.select(F.col("`page_id`"), url_host(url).alias("host"), url_path(url).alias("path"))
    distinct = stored(asked.groupBy("host", "path").agg(F.count("*").alias("n")))
    chains = stored(rule_chains(rules.select("host", "path", "verdict")))
    facts = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels")).first()
    count = distinct.count()
    labels = F.reverse(F.split("host", r"\."))
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, facts.labels))))
    keys = F.transform(depths, lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."), F.col("path")))
    urls = distinct.select("host", "path", F.explode(keys).alias("key"))
    ranges = max(MIN_RANGES, -(-count // URLS_PER_RANGE))
    bounds = F.lit(_bounds(urls, ranges, count)).cast("array<string>")
    at = lambda key: F.size(F.filter(bounds, lambda b: b <= key))
    last = F.concat("key", F.lit("\U0010ffff"))
    starts = chains.select(F.explode(F.sequence(at(F.col("key")), at(last))).alias("range"), "key", F.lit(0).alias("kind"), "chain", *[F.lit(None).cast("string").alias(c) for c in ("host", "path")])
    asks = urls.select(at(F.col("key")).alias("range"), "key", F.lit(1).alias("kind"), F.lit(None).cast(dict(chains.dtypes)["chain"]).alias("chain"), "host", "path")
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.union(asks).withColumn("chain", F.last("chain", ignorenulls=True).over(sweep)).where("kind = 1")
    still = F.filter("chain", lambda r: F.startswith(F.col("key"), r["prefix"]))
    best = F.element_at(still, -1)
    won = swept.where(F.size(still) > 0).select("host", "path", F.struct(F.length(best["rule"]).alias("n"), best["rule"].alias("rule"), best["verdict"].alias("verdict")).alias("best"))
    won = won.groupBy("host", "path").agg(F.max("best").alias("best"))
    out = asked.join(won, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))


def _bounds(urls: DataFrame, ranges: int, count: int) -> list[str]:
    """Boundaries from about SAMPLES_PER_RANGE keys per range, drawn by hash."""
    rate = min(1.0, ranges * SAMPLES_PER_RANGE / max(count, 1))
    draw = F.pmod(F.xxhash64("key", "host", "path"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = urls.where(draw < rate).select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("tile"))
    return sorted({r.key for r in sample.groupBy("tile").agg(F.min("key").alias("key")).where("tile > 1").collect()})
