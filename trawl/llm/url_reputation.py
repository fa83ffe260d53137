"""URL filtering by explicit rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and suffix.  The
rate of each level is shrunk towards its parent's: a suffix towards the share over all pages, a
domain towards its suffix, a host towards its domain, as the mean of a beta posterior
``(good + k * parent) / (n + k)``.  ``k`` is the prior strength of the level, estimated from all
groups of that level by the method of moments and kept within ``[MIN_PRIOR, MAX_PRIOR]``.  A page
is allowed if the host's posterior mean less ``z`` posterior standard deviations reaches
``threshold``; hosts without any label fall back on their domain, suffix or the overall rate.

Scale: the three levels are map-side combined counts; pages are read once for ids and urls (not
html) and joined by host, where adaptive execution splits a hot host or broadcasts a small table.
Null urls, and urls without ``://``: empty host and path, judged by the overall rate.  Null
outcomes teach nothing, of several outcomes of a page the worst counts.  Repeated rows are judged
alike and count as often as they occur; urls of any length are whole; an empty table gives no rows.
Registered domain: the last two labels; suffix: the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls; ties go to the rule listed first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def tail(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _strength(groups: DataFrame, mean: str, n: str, parent: str) -> DataFrame:
    """One row: the prior strength k of a level by moments of its groups' rates around their parents'."""
    p, var = F.sum(F.col(n) * F.col(parent)) / F.sum(n), F.sum(F.col(n) * (F.col(mean) - F.col(parent)) ** 2) / F.sum(n)
    noise = F.count(F.lit(1)) / F.sum(n)
    spread = p * (1 - p)
    between = F.greatest(var - spread * noise, spread * 1e-6)
    return groups.agg(F.least(F.lit(MAX_PRIOR), F.greatest(F.lit(MIN_PRIOR), F.coalesce(F.try_divide(spread, between) - 1, F.lit(MIN_PRIOR)))).alias("k"))


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, DataFrame]:
    """``pages(page_id, url)``, ``outcomes(page_id, good)`` → per host (host, mean, n, bound), and one row for hosts without one."""
    store = Stored(pages.sparkSession)
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    got = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").cast("double").alias("good"))
    by_host = hosts.groupBy("host", "page_id").agg(F.count(F.lit(1)).alias("m")).join(got, "page_id").groupBy("host").agg(F.sum("m").cast("double").alias("n"), F.sum(F.col("m") * F.col("good")).alias("s"))
    everywhere = hosts.select("host").distinct().join(by_host, "host", "left")
    everywhere = store.put(everywhere.select("host", tail(F.col("host"), 2).alias("domain"), tail(F.col("host"), 1).alias("suffix"), F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s")))

    top = everywhere.agg(((F.sum("s") + 1.0) / (F.sum("n") + 2.0)).alias("p"), F.sum("n").alias("n")).select(F.coalesce("p", F.lit(0.5)).alias("p"), F.coalesce("n", F.lit(0.0)).alias("total"))
    suffix = everywhere.groupBy("suffix").agg(F.sum("n").alias("xn"), F.sum("s").alias("xs")).join(F.broadcast(top))
    k = _strength(suffix.where("xn > 0").withColumn("r", F.col("xs") / F.col("xn")), "r", "xn", "p").withColumnRenamed("k", "k1")
    suffix = suffix.join(F.broadcast(k)).select("suffix", "k1", ((F.col("xs") + F.col("k1") * F.col("p")) / (F.col("xn") + F.col("k1"))).alias("xp"), "p", "total")
    domain = everywhere.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds")).join(suffix, "suffix")
    k = _strength(domain.where("dn > 0").withColumn("r", F.col("ds") / F.col("dn")), "r", "dn", "xp").withColumnRenamed("k", "k2")
    domain = domain.join(F.broadcast(k)).select("domain", ((F.col("ds") + F.col("k2") * F.col("xp")) / (F.col("dn") + F.col("k2"))).alias("dp"))
    host = everywhere.join(domain, "domain")
    k = _strength(host.where("n > 0").withColumn("r", F.col("s") / F.col("n")), "r", "n", "dp").withColumnRenamed("k", "k3")
    host = host.join(F.broadcast(k)).select("host", "n", ((F.col("s") + F.col("k3") * F.col("dp")) / (F.col("n") + F.col("k3"))).alias("mean"), (F.col("n") + F.col("k3")).alias("weight"))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return host.select("host", "mean", "n", bound.alias("bound")), top


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.6, z: float = 1.645) -> DataFrame:
    """``pages(page_id, url)`` → page_id, host, path, rule, verdict, reputation, bound."""
    known, _ = reputations(pages, outcomes, z)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.join(known, "host", "left")
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("reputation"), "bound")
